"""Statistics of a document's text, and whether it is natural text, a list, a table or junk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

# The commonest words of French, Occitan, English, Italian and German.
COMMON = frozenset(
    "le la les de des du un une et à au dans par pour que qui ce cette est se en sur ne pas "
    "lo li e a ab cum d'un es ni per plus quan que qu'ieu si ses son tan tot mas mi m'es en "
    "the of to and in is this that from with by on at for it as be which not but an "
    "il lo gli i di del della dell'ultima e un una in con per che non questa questo nel si al più "
    "der die das den dem des und in von zu mit auf ist nicht ein eine als aus aber dieser diese es".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_WHOLE = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?|\d+(?:[.,;\-]\d+)*|[IVXLC]+")
_SPOTS = re.compile(r"[\\/~^°_!*{}<>§¬`$%&@#�]")
_NOT_ALNUM = re.compile(r"[\W_]+")
_VOWELS = re.compile(r"[aeiouyàâäáãåæéèêëíìîïóòôöõœúùûü]", re.I)
_NOTE = re.compile(r"\[\^\d+\]:?")
_EDGES = ".,;:!?()«»*\"'“”‘’—–-[]#+…•|"
_MARK = re.compile(r"\s*(?:[-•–*+·▪]|\(?\d+[.)]|[a-z]\))\s+\S")
_ANY_MARK = re.compile(r"^" + _MARK.pattern, re.M)
_STRUCTURE = re.compile(r"[0-9=(]|\b[IVXLC]+\b")
_WORDS_TOGETHER = re.compile("a{2,}")
_CORE = re.compile(r"[\W_]*([\w][\w.'’^²-]*)")
_PAIRED = re.compile(r"Ã[\x80-\xbf]|Ã\s|Â[\xa0-\xbf]|â€|�")
_DELIMITERS = {"tab": re.compile(r"\t"), "bar": re.compile(r"\s\|\s|(?<=-)\|(?=-)"), "semicolon": re.compile(r"[;¦](?=\S)"), "dots": re.compile(r"\s\.{2,}\s"), "gap": re.compile(r"(?<=\S) {2,}(?=\S)")}
# What a text must hold for a delimiter to be looked for.
_HINTS = {"tab": "\t", "bar": "|", "semicolon": ";¦", "dots": "..", "gap": "  "}
#: Longest period looked for, and the autocorrelation that makes one.
MOST_PERIOD, PERIODIC = 8, 0.6


@lru_cache(maxsize=100_000)
def _word_kind(raw: str) -> int:
    """0 for edges alone, 1 for a whole word or number, 2 for anything else."""
    word = _NOTE.sub("", raw).strip(_EDGES)
    if not word:
        return 2 if raw.strip(_EDGES + "=") else 0
    return 1 if _WHOLE.fullmatch(word) and len(word) <= 40 else 2


def _broken(text: str) -> float:
    """Share of the words that are not whole words or numbers."""
    kinds = list(map(_word_kind, text.split()))
    n = len(kinds) - kinds.count(0)
    return kinds.count(2) / n if n else float(bool(kinds))


def autocorrelation(xs: list[int], lag: int = 1) -> float:
    """Autocorrelation at a lag; 0 for too few values, 1 for equal ones."""
    if len(xs) < lag + 2:
        return 0.0
    mean = sum(xs) / len(xs)
    var = sum((x - mean) ** 2 for x in xs)
    return sum((a - mean) * (b - mean) for a, b in zip(xs, xs[lag:], strict=False)) / var * len(xs) / (len(xs) - lag) if var else 1.0


def period(xs: list[int]) -> int:
    """The shortest lag of two or more at which a series that varies repeats itself, seen three times; 1 if it does not."""
    if len(set(xs)) < 2:
        return 1
    lags = [(autocorrelation(xs, p), -p) for p in range(2, min(MOST_PERIOD, len(xs) // 3) + 1)]
    best, p = max(lags, default=(0.0, -1))
    return -p if best >= PERIODIC else 1


def _columns(line: str, delimiter: re.Pattern, ordinal: bool) -> list[int]:
    """Where the cells of a line begin: by character, or by count for delimiters that themselves keep cells apart."""
    ends = [m.end() for m in delimiter.finditer(line)]
    return list(range(1, len(ends) + 1)) if ordinal else ends


def _aligned(a: list[int], b: list[int]) -> bool:
    """Whether most cells of two lines begin in the same columns, or a letter beside."""
    return bool(a) and bool(b) and 2 * sum(any(abs(x - y) <= 1 for y in b) for x in a) > len(a) and 2 * sum(any(abs(x - y) <= 1 for x in a) for y in b) > len(b)


def _table_rows(lines: list[str]) -> list[bool]:
    """Lines of short cells whose delimiters are aligned with those of a line beside.

    Runs of blanks are aligned if the cells behind them begin in the same
    columns of characters. Tabs, bars, semicolons and leaders are aligned if
    there are as many; a line by itself needs three.
    """
    out = [False] * len(lines)
    text = "\n".join(lines)
    for name, delimiter in _DELIMITERS.items():
        hint = _HINTS[name]
        if not (any(c in text for c in hint) if name == "semicolon" else hint in text):
            continue
        rows: list[list[int]] = []
        for line in lines:
            text = line.strip(" |") if name == "bar" else line.rstrip()
            columns = _columns(text, delimiter, name != "gap")
            if columns:
                cells = delimiter.split(text.strip())
                short = sum(len(c.split()) <= 3 and len(c.strip()) <= 24 for c in cells)
                columns = columns if short >= 0.75 * len(cells) else []
            rows.append(columns)
        if not any(rows):
            continue
        for i, row in enumerate(rows):
            lone = name == "bar" and len(row) >= 2 and lines[i].strip()[:1] == "|"
            same = _aligned if name == "gap" else lambda a, b: len(a) == len(b)
            if row and (lone or any(same(row, rows[j]) for j in (i - 1, i + 1) if 0 <= j < len(lines)) or (len(lines) == 1 and len(row) >= 3)):
                out[i] = True
    return out


@lru_cache(maxsize=100_000)
def _part(token: str) -> str:
    m = _CORE.match(token)
    if not m:
        return "=" if token == "=" else ""
    core = m[1].rstrip(".")
    kind = "9" if core[0].isdigit() else "R" if core.strip("IVXLC") == "" else "a"
    return "(" * (token[0] == "(") + kind + "".join(c for c in token[m.end() :] if c in ",;:)=")


def skeleton(line: str) -> str:
    """What a line is made of: ``a`` for words, ``9`` for a number, ``R`` for a numeral, with the delimiters beside them."""
    return _WORDS_TOGETHER.sub("a", "".join(map(_part, line.split())))


def _alike(a: str, b: str) -> bool:
    """Whether the delimiters of two lines agree as far as the shorter goes: a list of references may be longer beside."""
    short, long = sorted((a, b), key=len)
    return len(short) >= 2 and long.startswith(short) and any(c in short for c in "9R=(")


def _list_rows(lines: list[str], prose: float, marked: bool, structured: bool) -> list[bool]:
    """Lines that are entries, or go on with one.

    An entry begins with a mark, or is a line of few common words made like the
    line beside it: the same words, numbers and delimiters in the same order.
    Where entries run over several lines, the period of the indents or of the
    line lengths tells which line is beside. Indents that repeat themselves make
    entries without any mark; lines indented under an entry go on with it. Bare
    lines are entries among entries, or if nearly all are bare and their lengths
    do not hang together as those of wrapped prose do.
    """
    n = len(lines)
    out = [bool(_MARK.match(x)) for x in lines] if marked else [False] * n
    indent = [len(x) - len(x.lstrip()) for x in lines]
    hanging = period(indent) if any(indent) else 1
    if hanging > 1 and prose < 0.9:
        out = [True] * n
    if structured:
        step = hanging if hanging > 1 else period([len(x.rstrip()) for x in lines])
        made = [skeleton(x.strip()) if _STRUCTURE.search(x) and not x.lstrip().startswith("[^") else "" for x in lines]
        for i in range(n):
            near = {i - 1, i + 1, i - step, i + step}
            if not out[i] and made[i] and _thin(lines[i]) and any(0 <= j < n and j != i and _alike(made[i], made[j]) for j in near):
                out[i] = True
                # The lines up to the next entry belong to it, if the period says so.
                for k in range(i + 1, min(i + step, n)):
                    out[k] = True
    entries = list(out)
    if any(indent):
        for i in range(1, n):
            if out[i - 1] and not out[i] and indent[i] > 0 and indent[i] >= indent[i - 1]:
                out[i] = True
    bare = [len(x.split()) <= 4 and x.strip()[-1:] not in ".,;:!?…" for x in lines]
    if any(entries) and sum(e or b for e, b in zip(entries, bare, strict=True)) >= 0.8 * n:
        return [e or b for e, b in zip(out, bare, strict=True)]
    if n >= 3 and sum(bare) >= 0.9 * n and prose < 0.5 and autocorrelation([len(x) for x in lines]) < 0.5:
        return [e or b for e, b in zip(out, bare, strict=True)]
    return out


def _thin(line: str) -> bool:
    """Whether few of a line's words are common ones and none ends a sentence within it."""
    words = _WORD.findall(line)
    return sum(map(COMMON.__contains__, map(str.lower, words))) <= max(1, 0.25 * len(words)) and not re.search(r"[^\W\d_]{3}[.!?…] +[^\W\d_]", line)


def describe(text: str | None) -> tuple:
    """words, mean_word_length, symbol_ratio, ended_lines, common_words, form."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    words = _WORD.findall(text)
    n = len(words)
    size = len("".join(text.split()))
    symbols = size - len(_NOT_ALNUM.sub("", text))
    mean = sum(map(len, words)) / n if n else 0.0
    ended = sum(x.rstrip()[-1] in ".!?…:;,»\"" for x in lines) / len(lines) if lines else 0.0
    common = sum(map(COMMON.__contains__, map(str.lower, words))) / n if n else 0.0
    stats = (n, round(mean, 6), round(symbols / size, 6) if size else 0.0, round(ended, 6), round(common, 6))
    return (*stats, form_of(lines, words, ended, common))


def form_of(lines: list[str], words: list[str], ended: float, common: float) -> str:
    """``natural``, or what the greater part of the text is: ``list``, ``table`` or ``junk``."""
    if not lines or not words:
        return "junk"
    total = sum(len(x.strip()) for x in lines)
    if len(words) >= 8 and Counter(words).most_common(1)[0][1] > 0.6 * len(words):
        return "junk"
    if len(lines) >= 6 and Counter(lines).most_common(1)[0][1] > 0.6 * len(lines):
        return "junk"
    text = "\n".join(lines)
    marked, structured = bool(_ANY_MARK.search(text)), bool(_STRUCTURE.search(text))
    table = _table_rows(lines)
    entries = _list_rows(lines, ended, marked, structured)
    doubtful = _broken(text) > 0.1 or (any(c in text for c in "ÃÂâ�") and bool(_PAIRED.search(text)))
    letters = sum(map(len, words))
    if not any(table) and not any(entries) and letters >= 20 and common < 0.1 and len(_VOWELS.findall(text)) < 0.3 * letters:
        return "junk"
    of = Counter()
    for line, is_table, is_entry in zip(lines, table, entries, strict=True):
        kind = "natural"
        if doubtful and _junk(line, is_table, is_entry):
            kind = "junk"
        elif is_table:
            kind = "table"
        elif is_entry:
            kind = "list"
        of[kind] += len(line.strip())
    if of["natural"] * 2 >= total:
        return "natural"
    del of["natural"]
    return max(of, key=lambda k: (of[k], k))


def _junk(line: str, is_table: bool, is_entry: bool) -> bool:
    line = line.strip()
    if re.fullmatch(r"(?:<[^>]*>|\{\{[^}]*\}\}|\[\[[^\]]*\]\]|&\w+;|\s)+", line) or (len(line) < 12 and re.fullmatch(r"[^\w\s]*</?\w+.*", line)):
        return True
    if len(_PAIRED.findall(line)) * 12 > len(line):
        return True
    if is_table:
        return len(_SPOTS.findall(line)) > 0.05 * len(line)
    if re.fullmatch(r"[-—–*=_.\s]{1,80}", line) and len(line) < 8:
        return False
    return _broken(line) > (0.6 if is_entry else 0.25) and len(line) > 3


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, words, mean_word_length, symbol_ratio, ended_lines, common_words, form of every document.

    Whole texts are read, each line once. A null, empty or blank text has
    zeros and is junk; repeated rows give repeated results; other columns are
    not read.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = dict(rows.dtypes)["key"]
    out = rows.mapInPandas(_describe_all, f"key {kind}, words long, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, form string")
    return out.withColumnRenamed("key", key)


def _describe_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words", "form"]
    for x in batches:
        out = pd.DataFrame([describe(t) for t in x["text"]], columns=names)
        out.insert(0, "key", x["key"].to_numpy())
        yield out
