import pytest

pytest.importorskip("paperlake.llm")
