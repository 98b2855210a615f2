"""The text that the pages of a PDF file show, for fonts of one byte a character or with a map to Unicode.

Content streams are read in the order of the file, plain or deflated; encrypted files, and text drawn as
images or outlines, have none that could be read.
"""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<(?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*>>)*)>>\s*stream\r?\n")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?[0-9]*\.?[0-9]+|/?[A-Za-z*'\"][A-Za-z0-9*]*", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
GAP = -200.0  # thousandths of a letter's size that part words


def _streams(data: bytes) -> list[bytes]:
    out, at = [], 0
    while m := _STREAM.search(data, at):
        end = data.find(b"endstream", m.end())
        end = len(data) if end < 0 else end
        body, head, at = data[m.end() : end], m[1], end
        if b"FlateDecode" in head:
            try:
                out.append(zlib.decompressobj().decompress(body))
            except zlib.error:
                continue
        elif b"/Filter" not in head:
            out.append(body)
    return out


def _unicode_map(streams: list[bytes]) -> dict[int, str]:
    """Two-byte codes to characters, from the maps that fonts bring along."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for s in streams:
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", s, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]{4})>\s*<((?:[0-9A-Fa-f]{4})+)>", block):
                out[int(code, 16)] = text(to)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", s, re.S):
            for low, high, to in re.findall(rb"<([0-9A-Fa-f]{4})>\s*<([0-9A-Fa-f]{4})>\s*<([0-9A-Fa-f]{4})>", block):
                for k in range(int(low, 16), int(high, 16) + 1):
                    out[k] = chr(int(to, 16) + k - int(low, 16))
    return out


def _shown(token: bytes, wide: dict[int, str]) -> str:
    if token[:1] == b"(":
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _NAMED.get(m[1], m[1]), token[1:-1])
    else:
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if wide and len(raw) % 2 == 0:
        codes = [raw[k] << 8 | raw[k + 1] for k in range(0, len(raw), 2)]
        if all(c in wide for c in codes):
            return "".join(wide[c] for c in codes)
    return raw.decode("cp1252", "replace") if not raw.startswith(b"\xfe\xff") else raw[2:].decode("utf-16-be", "replace")


def pdf_text(data: bytes) -> str | None:
    if not data.lstrip().startswith(b"%PDF") or b"/Encrypt" in data:
        return None
    streams = _streams(data)
    wide, out = _unicode_map(streams), []
    for s in streams:
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", s, re.S):
            held: list[str] = []
            for token in _TOKEN.findall(block):
                if token[:1] in (b"(", b"<"):
                    held.append(_shown(token, wide))
                elif re.fullmatch(rb"[-+]?[0-9]*\.?[0-9]+", token):
                    if held and float(token) < GAP:
                        held.append(" ")
                elif token in (b"Tj", b"TJ", b"'", b'"'):
                    out.append("".join(held))
                    held = []
                elif token in (b"Td", b"TD", b"T*", b"Tm"):
                    out.append("\n")
                    held = []
            out.append("\n")
    return re.sub(r"\s+", " ", "".join(out)).strip() or None
