"""The test tree itself: pytest imports test modules by basename, so a repeated name hides a file."""

from collections import Counter
from pathlib import Path


def test_test_files_have_unique_names():
    names = Counter(p.name for p in Path(__file__).parent.rglob("test_*.py"))
    assert [n for n, c in names.items() if c > 1] == []
