"""Author, title, place, publisher and year out of descriptions of works."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from leafwork.llm.canon import canonical
from leafwork.llm.listing import plain

# Short forms of given names in common use. Others are learned, see people.learned_forms.
NICKNAMES = {
    "nanard": "bernard", "charlot": "charles", "titou": "jean-baptiste", "baptiste": "jean-baptiste", "suzette": "suzanne", "toinette": "antoinette", "gaby": "gabrielle", "lise": "elisabeth",
    "babette": "elisabeth", "margot": "marguerite", "guilhem": "guillaume", "colas": "nicolas", "tintin": "augustin", "sacha": "alexandre", "momon": "edmond", "doudou": "edouard",
    "jeannot": "jean", "pierrot": "pierre", "loulou": "louis", "manon": "marie", "ninon": "anne", "fanchon": "francoise", "dede": "andre", "totor": "victor", "mado": "madeleine",
    "bill": "william", "bob": "robert", "dick": "richard", "jo": "joseph", "joe": "joseph", "jim": "james", "jack": "john", "harry": "henry", "tom": "thomas", "mike": "michael", "ned": "edward",
    "ted": "edward", "betty": "elizabeth", "liz": "elizabeth", "peggy": "margaret", "meg": "margaret", "kate": "katherine", "cathy": "catherine", "molly": "mary", "nell": "helen",
    "fred": "frederic", "vince": "vincent", "phil": "philippe", "chris": "christophe", "alec": "alexander", "andy": "andrew", "ben": "benjamin", "dan": "daniel", "sam": "samuel", "tim": "timothy",
    "fritz": "friedrich", "hans": "johannes", "heinz": "heinrich", "willy": "wilhelm", "kalle": "karl-heinz", "resi": "therese", "sepp": "josef", "gretel": "margarete", "lotte": "charlotte", "toni": "anton",
    "beppe": "giuseppe", "peppe": "giuseppe", "cecco": "francesco", "nanni": "giovanni", "gianni": "giovanni", "gigi": "luigi", "mimmo": "domenico", "pippo": "filippo", "tonio": "antonio", "lella": "raffaella",
}
# Common given names. They help where a name's order is open; elsewhere the order is learned, see people.settled.
GIVEN = frozenset(
    "adam agnes albert alexandre alfred alice andre anna anne antoine antonio arthur august barbara benoit bernard bruno camille carl caroline catherine cecile charles charlotte "
    "christian claire claude clara daniel david denis dominique edmond edouard elisabeth elizabeth emile emma ernst etienne eugene eva felix fernand francesco francois francoise frank "
    "frederic friedrich gabriel georg georges gerard giovanni giulia giuseppe guillaume guy hans heinrich helene henri henry hermann hugo isabelle jacques james jean jeanne johann johannes john "
    "joseph julia jules karl klara laura laurent leon louis louise lucien ludwig luigi luisa madeleine marc marcel margaret marguerite maria marie marta martin mary mathilde maurice max michel "
    "nicolas olivier oscar otto paolo pascal paul peter philippe pierre rachel raymond rene richard robert roger rosa rudolf sara sophie stefan suzanne theodor thomas ulrich vincent walter wilhelm william xavier yves".split()
)
_PARTICLES = {"de", "di", "von", "van", "du", "della", "d"}
_HONOURS = re.compile(r"^(?:(?:l'abbé|le chanoine|le p\.|mgr|dr|prof\.?|abbé|chanoine)\s+)+", re.I)
_INITIAL = re.compile(r"(?:[^\W\d_]\.-?)+|[^\W\d_]")
_YEAR = re.compile(r"\b1[5-9]\d\d\b|\b20\d\d\b")
_PAGES = re.compile(r"(\d+)\s*p\.")


@dataclass(frozen=True)
class Name:
    """``given`` is a full given name, an abbreviation or initials with ``.``, or empty; ``other`` is the reading in the other order, where both may be meant."""

    surname: str
    given: str
    other: Name | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Work:
    author: Name | None
    title: str | None
    year: str | None
    place: str | None
    publisher: str | None
    pages: str | None


def _is_given(token: str) -> bool:
    low = plain(token)
    return low in GIVEN or low in NICKNAMES or (low.endswith(".") and len(low) > 2)


def _first(initials: str) -> str:
    """The first initial, with what a hyphen ties to it."""
    return re.match(r"\w(?:\.-\w)?", initials)[0] + "."


def given_form(token: str) -> str:
    low = plain(token)
    return NICKNAMES.get(low, low)


def parse_name(text: str | None) -> Name | None:
    """Surname and given name in any order and dress; particles, titles and second initials are dropped."""
    if not text:
        return None
    text = canonical(text).strip(" ,;'*-")
    text = _HONOURS.sub("", re.sub(r"\s*\((?:\d{4}|\?)[^)]*\)?$", "", text))
    text = re.sub(r"\(([^)]*)\)", r", \1", text)
    text = re.sub(r"(\.)(?=[^\W\d_]{2})", ". ", text)
    head, _, tail = text.partition(",")
    tokens = [(t, False) for t in head.split()] + [(t, True) for t in tail.replace(",", " ").split()]
    tokens = [(t.strip(",;'"), after) for t, after in tokens]
    tokens = [(t, after) for t, after in tokens if t and plain(t) not in _PARTICLES]
    if not tokens:
        return None
    initials = [t for t, _ in tokens if _INITIAL.fullmatch(t)]
    rest = [(t, after) for t, after in tokens if not _INITIAL.fullmatch(t)]
    if not rest:
        return None
    other = None
    known = [t for t, after in rest if after or (_is_given(t) and len(rest) > 1)]
    capitals = [t for t, after in rest if not after and len(t) > 2 and t.isupper()]
    if capitals:
        surname = max(capitals, key=len)
        given = next((t for t, _ in rest if t != surname and t not in capitals), "")
    elif known:
        given = known[0]
        left = [t for t, after in rest if t != given and not after] or [t for t, _ in rest if t != given] or [given]
        surname = left[-1]
    elif len(rest) > 1 and not initials:
        given, surname = rest[0][0], rest[-1][0]
        if given != surname:
            turned = Name(_letters_of(given), given_form(surname))
            other = turned if turned.surname else None
    else:
        given, surname = "", rest[-1][0]
    if surname == given:
        given = ""
    surname = _letters_of(surname)
    given = given_form(given) if given else (_first(plain(initials[0])) if initials else "")
    return Name(surname, given, other) if surname else None


def _letters_of(token: str) -> str:
    return re.sub(r"[^a-z]", "", plain(token))


def _publication(text: str) -> tuple[str | None, str | None, str | None, str | None]:
    years, pages = _YEAR.findall(text), _PAGES.search(text)
    publisher = re.search(r"éd\. ([^,(]+)", text)
    place = re.match(r"[\s,]*([^\W\d_][^,(:]*)", text)
    return years[-1] if years else None, place and place[1].strip() or None, publisher and publisher[1].strip() or None, pages and pages[1]


def parse_definition(text: str | None) -> Work | None:
    """The work a definition describes; None where it names no author (periodicals, manuscripts) or is empty."""
    if not text:
        return None
    text = re.sub(r"^(?:voir|cf\.)\s+", "", canonical(text).strip(), flags=re.I)
    if text.startswith("chansonniers"):
        return None
    marked = re.match(r"(.*?)[,\s]*'?\*([^*]*)\*?'?(.*)$", text, re.S)
    if marked:
        author, title, rest = marked.groups()
        if not author.strip(" ,'"):
            by = re.match(r"\s*,\s*par\s+(.*)$", rest, re.S)
            if not by:
                return None
            parts = by[1].rsplit(", ", 2)
            author, rest = (parts[0], ", ".join(parts[1:])) if len(parts) > 2 else (by[1], "")
    else:
        parts = text.split(", ")
        cut = 2 if len(parts) > 2 and " " not in parts[1] and len(parts[1]) < 16 else 1
        author, title, rest = ", ".join(parts[:cut]), ", ".join(parts[cut:]), ""
    name = parse_name(author)
    if name is None:
        return None
    if "réimpr" in rest or re.match(r"[\s,']*dans \*", rest):
        # The year of a reprint is not the work's; that of a volume or journal is.
        year = None if "réimpr" in rest else (_YEAR.findall(rest) or [None])[-1]
        return Work(name, title.strip(" ,'"), year, None, None, None)
    return Work(name, title.strip(" ,'"), *_publication(rest))


def parse_card(heading: str | None, title_line: str, imprint: str | None, extent: str | None) -> Work:
    """The work a library card describes; the author stands in the heading or behind the title."""
    title, _, by = canonical(title_line).partition(" / ")
    name = parse_name(heading) or parse_name(re.sub(r"^(?:par|by|von|di|da|de)\s+", "", by))
    year, place, _, _ = _publication(canonical(imprint or ""))
    publisher = re.search(r":\s*([^,\[]+)", imprint or "")
    pages = _PAGES.search(canonical(extent or ""))
    return Work(name, title.replace(" : ", ", ").strip(), year, None if place and place.startswith("[") else place, publisher and publisher[1].strip() or None, pages and pages[1])


def parse_entry(author: str | None, title: str | None, text: str | None) -> Work:
    """The work of a bibliography entry ``- AUTHOR, *Title*, Place, éd. Publisher, Year.``"""
    inside = parse_definition(re.sub(r"^-\s*", "", text or ""))
    name = inside.author if inside and inside.author and inside.author.given else parse_name(author)
    return Work(name, title and canonical(title), *((inside.year, inside.place, inside.publisher, inside.pages) if inside else (None,) * 4))
