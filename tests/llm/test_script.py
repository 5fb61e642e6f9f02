"""The script of a text is told by all of its letters."""

from docketlake.llm import fertility


def test_script_counts_every_letter():
    for text in ("αλφα 12345" * 1000, "word яяяяя " * 3000, "é" * 7 + "я" * 6, "я" * 7 + "ễ" * 6, "12 34", "", ("я" + "a" * 3) * 1000):
        letters = [c for c in text if c.isalpha()]
        latin = sum(ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 for c in letters)
        assert fertility.script_of(text) == ("latin" if letters and latin * 2 >= len(letters) else "default")
