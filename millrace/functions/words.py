"""Plain-Python text helpers for Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

#: Characters without width that may stand inside a word.
INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁤﻿]")
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-case words after NFKC, without invisible characters; [] for null."""
    return WORD.findall(unicodedata.normalize("NFKC", INVISIBLE.sub("", text or "")).lower())
