"""Regular expressions of the query language, rewritten for Java's engine."""

from __future__ import annotations

import re

from docquill.errors import InvalidQuery


def to_java(pattern: str, options: str = "") -> str:
    r"""A linear-time dialect's pattern as a Java pattern with the same matches.

    Only ``i`` of the options counts. ``.`` and ``$`` know no line end but \n, ``$`` means the very end,
    classes and case folding are those of Unicode. Look-around and back-references are refused.
    """
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern):
        raise InvalidQuery("look-around isn't supported in $regex")
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            if pattern[k + 1].isdigit() and pattern[k + 1] != "0":
                raise InvalidQuery("back-references aren't supported in $regex")
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(r"\z" if c == "$" and not inside else c)
        k += 1
    return f"(?dU{'iu' if 'i' in options else ''})" + "".join(out)
