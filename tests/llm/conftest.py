import pytest

pytest.importorskip("orrery.llm")
