import pytest

pytest.importorskip("scriptorium.llm")
