"""Lines of scanned pages: running heads, leaf numbers, cut words."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from leafwork.llm.bktree import levenshtein
from leafwork.llm.canon import canonical
from leafwork.llm.listing import plain

# Characters that a scan reads for a letter or a digit.
_TO_LETTER = str.maketrans({"0": "o", "1": "l", "5": "s", "9": "g", "6": "e", "@": "a", "!": "i", "8": "b", "|": "l", "2": "z"})
_HYPHEN = re.compile(r"([^\W\d_]+)[-‐‑\xad¬]$")
_NUMBER = r"(?:(?=\S*\d)[0-9OolISZbgAB?'’]{1,6}|[ivxl1]{1,6})(?:\s?b?is)?"
_FOLIO = re.compile(rf"^(?P<open>[-—–•\[(]\s*|p\.\s*)?(?P<number>{_NUMBER}|[OolISZbgAB]{{2,4}})\s*(?P<close>[-—–•\])]|\.)?$")
_SPACED = re.compile(r"\S\s\S\s\S\s\S\s")
_BESIDE = re.compile(rf"^(?:{_NUMBER})\s+(?=\S{{2}}|\S\s)|\s+(?:[.·]\s*)?(?:{_NUMBER})$")


@dataclass
class Line:
    """One line of a page: ``no`` from 1, ``kind`` header, folio, fence, verse, note, text or blank."""

    no: int
    kind: str
    raw: str
    text: str


def head_key(line: str) -> str:
    """The letters of a line without a number before or behind them, scan slips in letters undone."""
    return re.sub(r"[^a-z]", "", plain(_BESIDE.sub("", line.strip(), count=1)).translate(_TO_LETTER))


def _at_edge(position: int, count: int) -> bool:
    return position < 2 or position >= count - 2


def edge_keys(body: str) -> list[tuple[str, int]]:
    """(key, 1) of the outermost lines of a page that may be its running head, (key, 0) of the headings within, (key, 2) of other lines that look like one."""
    lines = [x.strip() for x in canonical(body).split("\n")]
    filled = [i for i, x in enumerate(lines) if x]
    if len(filled) < 2:
        return []
    outer = {filled[0], filled[-1]}
    outer |= {filled[1]} if _FOLIO.match(lines[filled[0]]) else set()
    outer |= {filled[-2]} if _FOLIO.match(lines[filled[-1]]) else set()
    out = {}
    for rank, i in enumerate(filled):
        x = lines[i]
        if x[-1] in ".,;:!?" or x.startswith((":::", "[^")) or _FOLIO.match(x):
            continue
        kind = 1 if i in outer else 0 if _alone(lines, i) else 2 if _showy(x) or (_at_edge(rank, len(filled)) and (x[0].isupper() or _BESIDE.search(x))) else None
        if kind is not None and (k := head_key(x)):
            out[k, kind] = None
    return sorted(out)


def _showy(line: str) -> bool:
    """In capitals, letter-spaced, or begun by a capital and ended by a number."""
    if sum(map(str.isupper, line)) > 0.6 * sum(map(str.isalpha, line)) or _SPACED.search(line):
        return True
    return line[0].isupper() and line[-1].isdigit() and _BESIDE.search(line) is not None


def _is_head(line: str, heads: frozenset[str], alone: bool, edge: bool) -> bool:
    if line.startswith((":::", "[^", "*")):
        return False
    if not (edge and line[-1] not in ".,;:!?" and (alone or line[:1].isupper() or _BESIDE.search(line))) and not _showy(line):
        return False
    if _FOLIO.match(line):
        return False
    key = head_key(line)
    if not key:
        return False
    if key in heads:
        return True
    slack = max(1, len(key) // 6)
    return any(abs(len(h) - len(key)) <= slack and levenshtein(key, h) <= slack for h in heads)


def _is_folio(line: str, expected: str, before: str) -> bool:
    m = _FOLIO.match(line)
    if not m or re.search(r"\b[pv]\.$", before):
        return False
    number = re.sub(r"\s", "", m["number"])
    if m["open"] and (m["open"].startswith("p") and not m["close"] or not m["open"].startswith("p") and m["close"]):
        return True
    want = re.sub(r"\s", "", expected)
    if not want or abs(len(number) - len(want)) > 1:
        return False
    return levenshtein(number, want) <= max(1, len(want) // 2) or sorted(number) == sorted(want)


def lines_of(body: str | None, heads: frozenset[str], expected: str) -> list[Line]:
    """The lines of a page by kind. ``heads`` are the keys of its volume's running heads, ``expected`` the leaf's number."""
    if not body:
        return []
    raws = body.split("\n")
    whole = canonical(body).split("\n")  # at once, unless that joins or parts lines
    texts = [x.rstrip() for x in (whole if len(whole) == len(raws) else map(canonical, raws))]
    filled = [i for i, t in enumerate(texts) if t.strip()]
    rank = {i: k for k, i in enumerate(filled)}
    out, verse, note = [], False, False
    for i, (raw, text) in enumerate(zip(raws, texts, strict=True)):
        bare = text.strip()
        kind = "text"
        if not bare:
            kind, note = "blank", False
        elif bare.startswith(":::"):
            kind, verse = "fence", len(bare) > 3
        elif verse:
            kind = "verse"
        elif len(filled) > 1 and _is_head(bare, heads, _alone(texts, i), _at_edge(rank[i], len(filled))):
            kind = "header"
        elif re.match(r"\[\^[^\]]+\]:", bare):
            kind, note = "note", True
        elif note:
            kind = "note"
        out.append(Line(i + 1, kind, raw, text))
    outer = [x for x in out if x.kind not in ("blank", "header")]
    for x in {id(y): y for y in (*outer[:1], *outer[-1:])}.values():
        if x.kind in ("text", "note") and _is_folio(x.text.strip(), expected, next((y.text for y in reversed(out[: x.no - 1]) if y.text.strip()), "")):
            x.kind = "folio"
    return out


def _alone(texts: list[str], i: int) -> bool:
    return (i == 0 or not texts[i - 1].strip()) and (i + 1 == len(texts) or not texts[i + 1].strip())


def cut_stem(raw: str) -> str | None:
    """The letters before a hyphen that ends the line, if there are any."""
    stripped = raw.rstrip(" \t\r​‌‍⁠﻿")
    if not stripped:
        return None
    ends = stripped[-1] in "-‐‑\xad¬－"
    m = _HYPHEN.search(canonical(stripped[:-1]).rstrip("-") + "-") if ends else None
    return m[1] if m else None


def first_letters(text: str) -> str | None:
    m = re.match(r"[*_\"«(]*([^\W\d_]+)", text.strip())
    return m[1] if m else None


def fit_numbers(leaves: list[tuple[int, str, bool]]) -> dict[int, str]:
    """The number each leaf bears, by index.

    ``leaves`` are (index, number read, plate known) in any order, ``""`` where
    nothing was read. Leaves follow in order: a first run of roman numerals,
    then numbers that grow by one, plates without a number, inserted leaves with
    the number before and ``bis``. The sequence that contradicts the fewest
    readings is taken, found by dynamic programming over the last number; all
    states are kept, of which there are at most leaves times starts.
    """
    leaves = sorted({i: (i, s.strip(), p) for i, s, p in leaves}.values())
    if not leaves:
        return {}
    # State: (kind of numerals, last number); each has its cost and the leaves' numbers, last first.
    states: dict[tuple[str, int], tuple[float, tuple]] = {("none", 0): (0.0, ())}
    starts_a = {int(s) - k for k, (_, s, _) in enumerate(leaves) if s.isdigit() and int(s) > 0}
    starts_r = sorted({n - k for k, (_, s, _) in enumerate(leaves) if (n := from_roman(s))})
    last = None
    for k, (i, s, plate) in enumerate(leaves):
        gap = 0 if last is None else i - last - 1
        last = i
        new: dict[tuple[str, int], tuple[float, tuple]] = {}

        def put(state, cost, number, path, new=new):
            if state not in new or cost < new[state][0]:
                new[state] = (cost, (number, path))

        begins = s.isdigit() and int(s) > 0 and str(int(s)) == s and any(int(s) - k + d in starts_a for d in (-1, 0, 1))
        for (kind, n), (cost, path) in states.items():
            skips = range(gap + 1) if kind != "none" else range(1)
            for skip in skips:
                lost = 0.1 * (gap - skip) if kind != "none" else 0.0
                m = n + skip
                none = 0.0 if plate and not s else 0.3 if not s else 1.6
                put((kind, m), cost + lost + none, "", path)
                if kind == "none":
                    continue
                number = str(m + 1) if kind == "arabic" else to_roman(m + 1)
                put((kind, m + 1), cost + lost + _misfit(s, number, plate), number, path)
                if kind == "arabic":
                    bis = f"{m} bis"
                    put((kind, m), cost + lost + (0.05 if s == bis else 0.9 if "b" in s and len(s) > len(str(m)) + 2 else 2.2), bis, path)
            if kind == "none":
                for start in starts_r:
                    if start + k > 0:
                        put(("roman", start + k), cost + _misfit(s, to_roman(start + k), plate) + 0.2, to_roman(start + k), path)
            if kind in ("none", "roman"):
                if begins:
                    put(("arabic", int(s)), cost + 0.3, s, path)
        states = dict(sorted(new.items(), key=lambda e: (e[1][0], e[0])))
    _, path = next(iter(states.values()))
    out = {}
    for i, _, _ in reversed(leaves):
        out[i], path = path
    return {i: out[i] for i, _, _ in leaves}


def _misfit(read: str, number: str, plate: bool) -> float:
    if read == number:
        return 0.0
    if not read:
        return 0.8 if plate else 0.25
    return 1.0 if levenshtein(read, number) <= max(1, len(number) // 2) else 1.3


_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def to_roman(n: int) -> str:
    out = ""
    for value, letters in _ROMAN:
        while n >= value:
            out, n = out + letters, n - value
    return out


def from_roman(text: str) -> int:
    """The value of a small lower-case roman numeral; 0 for anything else."""
    n, rest = 0, text
    for value, letters in _ROMAN:
        while rest.startswith(letters):
            n, rest = n + value, rest[len(letters) :]
    return n if text and not rest and to_roman(n) == text else 0


class Token(NamedTuple):
    """A word of a line; one cut at the line's end holds both parts, ``split`` letters of it on line ``no``, the rest on ``rest``."""

    no: int
    word: str
    split: int
    rest: int
    start: bool


_TOKEN = re.compile(r"(?:[^\W_]|[@!|](?=[^\W\d_])|(?<=[^\W\d_])[@!])+(?:-[^\W\d_]+)*")
_ASIDE = re.compile(r"\{[^}]*\}|\[\^[^\]]*\]:?")


def cuts_of(lines: list[Line]) -> dict[int, tuple[str, str | None, int]]:
    """Line number -> letters before the hyphen, letters of the rest (None if the page ends there), the rest's line."""
    out = {}
    body = [x for x in lines if x.kind in ("text", "note", "blank")]
    for k, x in enumerate(body):
        stem = cut_stem(x.raw) if x.kind != "blank" else None
        if not stem:
            continue
        after = body[k + 1] if k + 1 < len(body) else None
        if after and after.kind != "blank" and not (x.kind == "text" and after.kind == "note"):
            rest = first_letters(after.text)
            if rest and not rest[0].isupper():
                out[x.no] = (stem, rest, after.no)
        elif x.kind == "text" and not any(y.kind == "text" for y in body[k + 1 :]):
            out[x.no] = (stem, None, 0)
    return out


def tokens_of(lines: list[Line], cuts: dict[int, tuple[str, str | None, int]]) -> list[Token]:
    """The words of text and note lines in order, cut words made whole; a line's first token starts anew."""
    out, taken = [], {}
    for x in lines:
        if x.kind not in ("text", "note"):
            continue
        words = _TOKEN.findall(_ASIDE.sub(" ", re.sub(r"[-¬]$", "", x.text) if x.no in cuts else x.text))
        if x.no in taken and words:
            words = words[1:]
        for k, w in enumerate(words):
            split, rest = 0, 0
            if k == len(words) - 1 and x.no in cuts and cuts[x.no][2]:
                joined = next((y for y in lines if y.no == cuts[x.no][2]), None)
                head = _TOKEN.match(joined.text.lstrip()) if joined else None
                if head:
                    split, rest = len(w), joined.no
                    w, taken[joined.no] = w + head[0], True
            elif k == len(words) - 1 and x.no in cuts:
                continue
            if len(w) > 1 and any(map(str.isalpha, w)):
                out.append(Token(x.no, w.lower(), split, rest, k == 0 and x.no not in taken))
    return out
