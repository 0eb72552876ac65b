"""Variant spellings of names typed by people (problem 6): parsing, phonetic codes and comparison of names."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from caudal.llm.leakage import words_of
from caudal.llm.mojibake import repair

# Nicknames and the given name each stands for.
NICKNAMES = {
    "pancho": "francisco", "paco": "francisco", "fran": "francisco", "pepe": "jose", "cote": "jose", "chepe": "jose", "nacho": "ignacio", "nano": "fernando", "nando": "fernando",
    "lalo": "eduardo", "edu": "eduardo", "beto": "roberto", "tito": "hector", "tono": "antonio", "toño": "antonio", "quique": "enrique", "kike": "enrique", "memo": "guillermo", "guille": "guillermo",
    "willy": "guillermo", "rafa": "rafael", "rodri": "rodrigo", "seba": "sebastian", "pato": "patricio", "manolo": "manuel", "manu": "manuel", "nico": "nicolas", "mati": "matias", "ale": "alejandro",
    "jano": "alejandro", "cris": "cristian", "javi": "javier", "gonza": "gonzalo", "gabo": "gabriel", "gabi": "gabriel", "joaco": "joaquin", "tomi": "tomas", "moncho": "ramon", "nan": "hernan",
    "chela": "marcela", "marce": "marcela", "ceci": "cecilia", "chabela": "isabel", "isa": "isabel", "chavela": "isabel", "lupe": "guadalupe", "lupita": "guadalupe", "sole": "soledad", "lola": "dolores",
    "loli": "dolores", "tere": "teresa", "teresita": "teresa", "concha": "concepcion", "conchita": "concepcion", "meche": "mercedes", "merche": "mercedes", "vero": "veronica", "moni": "monica",
    "barbi": "barbara", "babi": "barbara", "bea": "beatriz", "betty": "beatriz", "sofi": "sofia", "lucy": "lucia", "luci": "lucia", "leo": "leonor", "nora": "leonor", "chelo": "consuelo", "charo": "rosario",
    "chayo": "rosario", "xime": "ximena", "yoli": "yolanda", "elenita": "elena", "nena": "elena", "pili": "pilar", "caro": "carolina", "quino": "joaquin", "rorro": "rodrigo", "panchito": "francisco", "andy": "andres", "raulito": "raul", "osquitar": "oscar", "inesita": "ines",
}
# Given names of the region.
GIVEN = frozenset(
    "francisco jose ignacio fernando eduardo roberto hector antonio enrique guillermo rafael rodrigo sebastian patricio manuel nicolas matias alejandro cristian javier gonzalo gabriel joaquin tomas ramon "
    "hernan marcela cecilia isabel guadalupe soledad dolores teresa concepcion mercedes veronica monica barbara beatriz sofia lucia leonor consuelo rosario ximena yolanda elena pilar carolina andres raul "
    "oscar ines juan pedro luis carlos jorge miguel pablo diego felipe maria ana carmen rosa claudia patricia andrea paula daniela camila valentina".split()
)
# Words for a firm's legal form and branch, and small words; none tells firms apart.
FORMS = frozenset(
    "limitada ltda lda spa sa sas eirl srl compania cia hermanos hnos hijos sociedadanonima anonima responsabilidad sucursal suc matriz casa calle vigente no n e y de del la las los el en con para por".split()
)
# Forms that end a name and are looked for with one mistyped letter there.
ENDINGS = ("eirl", "ltda", "spa")
# Lines of business and the short forms they are written in.
LINES = {
    "alimentos": "alim alimen", "imprenta": "impr impta", "consultores": "cons consult consul", "ferreteria": "ferret ferr ferretera", "constructora": "const constr construct", "construccion": "construc", "ingenieria": "ing ingen ingenieros ingeniera",
    "inversiones": "inv invers", "libreria": "libr lib librera", "integrales": "integ integr int", "importadora": "imp import", "metalurgica": "metal metalurg met", "transportes": "ttes transp transpor transporte trans tptes",
    "comercializadora": "com comerc comercializ", "maquinarias": "maq maquin maquinaria", "distribuidora": "dist distrib distr distri", "comercial": "cial coml com comerc comer", "agricola": "agr agric", "laboratorios": "labs lab laborat",
    "tecnologias": "tec tecno tecn tecnol tecnologia", "mantencion": "mant mantenc manten", "sociedad": "soc socied", "servicios": "serv ss svcs svc servs servic",
}
# Kinds of buying units and the short forms they are written in.
UNITS = {
    "direccion": "dir direcc dire", "departamento": "depto dpto dep depart", "unidad": "u unid uni", "obras": "obr", "escuela": "esc", "infantil": "inf", "jardin": "j jard", "centro": "ctro c cto cent", "adquisiciones": "adq adquis adqs",
    "oficina": "of ofic", "bodega": "bod", "provincial": "prov", "administracion": "adm admin", "hospital": "hptal hosp hosptl", "abastecimiento": "abast abastec abas", "salud": "sal", "municipal": "mun",
}
SUFFIXES = frozenset(["central", "anexo"])
PLACE = frozenset("sur norte los las villa viejo alto poniente oriente puerto bajo barra".split())


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used = [False] * lb
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(lb) if used[j]]
    t = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


@lru_cache(maxsize=200_000)
def _letters(word: str) -> int:
    """The set of letters of a word as bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def edits(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) that turn a into b, or most + 1 if more.

    One edit changes at most two letters of the set of letters, so most pairs need no table. What both begin
    and end with is left out, and of the table only the cells within ``most`` of the diagonal are filled.
    """
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return most + 1
    start = 0
    while start < la and start < lb and a[start] == b[start]:
        start += 1
    while la > start and lb > start and a[la - 1] == b[lb - 1]:
        la -= 1
        lb -= 1
    a, b, la, lb = a[start:la], b[start:lb], la - start, lb - start
    if not la or not lb:
        return la + lb
    far = most + 1
    older, before = [far] * (lb + 1), [j if j <= most else far for j in range(lb + 1)]
    for i in range(1, la + 1):
        x, lo, hi = a[i - 1], max(1, i - most), min(lb, i + most)
        row = [far] * (lb + 1)
        if i <= most:
            row[0] = i
        least = row[0]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            d = before[j - 1] + (x != y)
            if before[j] + 1 < d:
                d = before[j] + 1
            if row[j - 1] + 1 < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and older[j - 2] + 1 < d:
                d = older[j - 2] + 1
            row[j] = d
            if d < least:
                least = d
        if least > most:
            return far
        older, before = before, row
    return min(before[lb], far)


# Letters that Spanish speakers hear alike.
_SOUNDS = [
    (r"qu(?=[ei])", "k"), (r"gu(?=[ei])", "g"), (r"c(?=[ei])", "s"), (r"ch", "x"), (r"g(?=[ei])", "j"), (r"ll", "y"), (r"[ckq]", "k"), (r"[zs]", "s"), (r"[vw]", "b"), (r"h", ""), (r"(.)\1+", r"\1"),
]
_SOUNDS = [(re.compile(p), r) for p, r in _SOUNDS]


@lru_cache(maxsize=200_000)
def phonetic(word: str) -> str:
    """Spanish phonetic code: first sound, then consonants."""
    for p, r in _SOUNDS:
        word = p.sub(r, word)
    return (word[:1] + re.sub(r"[aeiou]", "", word[1:]))[:6]


@dataclass(frozen=True)
class Name:
    core: tuple[str, ...]  # telling words in the order given
    given: tuple[str, ...]
    initials: tuple[str, ...]
    kind: frozenset[str]  # lines of business or kinds of units
    suffix: str

    @property
    def person(self) -> bool:
        return bool(self.given) and not (self.kind - {"servicios"})


_DOTTED = re.compile(r"\b((?:[A-Za-z]\.){2,})([A-Za-z]?)(?=[\s.,;)(-]|$)")
_SHORT = {s: w for table in (LINES,) for w, short in table.items() for s in short.split()}
_SHORT_UNITS = {s: w for w, short in UNITS.items() for s in short.split()}


@lru_cache(maxsize=200_000)
def _canonical(word: str, units: bool) -> str | None:
    """The line of business (kind of unit) that ``word`` spells, shortens or misspells."""
    table, short = (UNITS, _SHORT_UNITS) if units else (LINES, _SHORT)
    if word in table:
        return word
    if word in short:
        return short[word]
    if len(word) >= 4:
        for w in table:
            if len(word) >= 5 and w.startswith(word) or len(word) >= 7 and w.endswith(word):
                return w
            if len(w) >= 5 and abs(len(w) - len(word)) <= 2 and (w[0] == word[0] or w[-1] == word[-1] or w[1] == word[1]):
                most = 1 if len(w) < 8 else 2
                if edits(word, w, most) <= most:
                    return w
        for form, w in short.items():
            if len(form) >= 5 and len(word) >= 5 and form[0] == word[0] and edits(word, form, 1) <= 1:
                return w
    return None


@lru_cache(maxsize=200_000)
def _form(word: str) -> bool:
    """Whether a word is one of a legal form, as it is or mistyped."""
    return word in FORMS or len(word) >= 6 and any(edits(word, f, 2) <= 2 for f in ("limitada", "hermanos", "compania"))


@lru_cache(maxsize=100_000)
def _near_given(word: str) -> str | None:
    """The given name that a word misspells by one letter."""
    return next((g for g in sorted(GIVEN) if word[0] == g[0] and edits(word, g, 1) <= 1), None) if len(word) >= 4 else None


@lru_cache(maxsize=100_000)
def _misspelt_nickname(word: str) -> str | None:
    """The given name of a nickname with one doubled or missing letter."""
    bare = re.sub(r"(.)\1", r"\1", word)
    return NICKNAMES.get(bare) if bare != word else None


@lru_cache(maxsize=100_000)
def parse(text: str | None, units: bool = False) -> Name | None:
    """Parts of a name; None where nothing is left."""
    if not text:
        return None
    text = (repair(text)[2] or "").replace("�", "").replace("?", "")
    text = _DOTTED.sub(lambda m: m[1].replace(".", "") + m[2], text)
    text = re.sub(r"\b[sS]\.\s?[pP]\.?\s?[aA]\b\.?", "spa", text)
    text = re.split(r"\s[–-]\s(?:calle|casa|local|of)\b", text, flags=re.I)[0]
    words = words_of(re.sub(r"(?<=[a-zñáéíóúü])(?=[A-ZÑÁÉÍÓÚÜ][a-zñáéíóúü])", " ", text))
    core, given, initials, kind, suffix = [], [], [], set(), ""
    for w in words:
        if _form(w) or w is words[-1] and len(w) > 2 and any(edits(w, f, 1) <= 1 for f in ENDINGS):
            continue
        k = _canonical(w, units)
        if units and (w in SUFFIXES or len(w) >= 5 and any(edits(w, s, 1) <= 1 for s in SUFFIXES)):
            suffix = "central" if w[0] == "c" else "anexo"
        elif k and not (len(w) == 1 and units and core):
            kind.add(k)
        elif len(w) == 1:
            if w.isalpha():
                initials.append(w)
        elif w.isdigit():
            continue
        else:
            full = w if w in GIVEN else NICKNAMES.get(w) or (_misspelt_nickname(w) if len(w) >= 5 else None)
            if not units and full:
                given.append(full)
            else:
                core.append(w)
    if not units:  # misspelt given names of persons
        if not kind - {"servicios"}:
            rest = []
            for w in core:
                near = _near_given(w) if len(core) > 1 else None
                if near and len(given) < 2 and len(core) - len(rest) > 1 and not (given and len(core) <= 2):
                    given.append(near)
                else:
                    rest.append(w)
            core = rest
        else:  # firms may be called after words that are also nicknames
            core = [w for w in words if w in core or (w in GIVEN or w in NICKNAMES)]
            given = []
    if not core and not given:
        return None
    return Name(tuple(core), tuple(given), tuple(initials), frozenset(kind), suffix)


def codes(name: Name) -> list[str]:
    """Phonetic codes of the telling words, sorted."""
    return sorted({phonetic(w) for w in name.core if w not in PLACE} | {phonetic(g) for g in name.given})


def _like(a: str, b: str) -> float:
    """Jaro-Winkler of two words, 0 where they are too many edits apart for one word mistyped twice."""
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    most = 1 if longest < 5 else 2 if longest < 9 else 3
    e = edits(a, b, most)
    if e > most:
        return 0.0
    return max(0.93, jaro_winkler(a, b)) if e == 1 and longest > 4 else jaro_winkler(a, b)


def align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[list[float], list[str], list[str]]:
    """Greedy best pairs of words by Jaro-Winkler (at least 0.8), and the words left on either side."""
    pairs = sorted(((_like(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    ia, ib, got = set(), set(), []
    for s, i, j in pairs:
        if s < 0.8:
            break
        if i not in ia and j not in ib:
            ia.add(i)
            ib.add(j)
            got.append(s)
    return got, [x for i, x in enumerate(a) if i not in ia], [y for j, y in enumerate(b) if j not in ib]


def _take_initials(rest: list[str], initials: list[str]) -> list[str]:
    out = []
    for w in rest:
        if w[0] in initials:
            initials.remove(w[0])
        else:
            out.append(w)
    return out


def similarity(a: Name, b: Name, units: bool = False) -> float:
    """How alike two names are, from 0 (differ in a telling part) to 1."""
    if a.suffix and b.suffix and a.suffix != b.suffix:
        return 0.0
    ka, kb = a.kind - {"sociedad", "servicios"}, b.kind - {"sociedad", "servicios"}
    if "com" not in ka and ka and kb and not ka & kb and not ({"comercial", "comercializadora"} & ka and {"comercial", "comercializadora"} & kb):
        return 0.0
    if units and ka and kb and not (ka <= kb or kb <= ka):
        return 0.0
    got, left, right = align(a.core, b.core)
    ga, gb = list(a.given), list(b.given)
    if a.person or b.person:
        same = [g for g in dict.fromkeys(ga) if g in gb]
        ga, gb = [g for g in ga if g not in same], [g for g in gb if g not in same]
        ga, gb = _take_initials(ga, list(b.initials)), _take_initials(gb, list(a.initials))
        if ga and gb or bool(a.kind - {"servicios"}) != bool(b.kind - {"servicios"}) and (a.given and b.kind - {"servicios"} or b.given and a.kind - {"servicios"}):
            return 0.0
        if a.given and b.given and not same and not (a.initials or b.initials):
            return 0.0
        left, right = _take_initials(left, list(b.initials)), _take_initials(right, list(a.initials))
        if ga and right or gb and left:
            return 0.0
        if left and right or not got:
            joined = _joined(a, b)
            return joined if joined >= 0.9 and (same or not a.given or not b.given) else 0.0
        if not same and len(got) < 2:
            return 0.0
        missing = len(left) + len(right) + (0 if same else 1)
        return sum(got) / len(got) * (1 - 0.06 * missing)
    if left and right:
        joined = _joined(a, b)
        return joined if joined >= 0.9 else 0.0
    if not got:
        return 0.0
    if units:
        lost = [w for w in left + right]
        return sum(got) / len(got) * (1 - 0.12 * len(lost))
    missing = len(left) + len(right)
    if missing and len(got) < 2:
        joined = _joined(a, b)
        return joined if joined >= 0.9 else 0.0
    return sum(got) / len(got) * (1 - 0.05 * missing)


def _joined(a: Name, b: Name) -> float:
    """Similarity of the telling words run together, for split and joined words."""
    best = 0.0
    for x in {"".join(a.core), "".join(reversed(a.core))}:
        y = "".join(b.core)
        if min(len(x), len(y)) >= 6:
            e = edits(x, y, 3)
            if e <= 3 and e * 5 <= min(len(x), len(y)):
                best = max(best, 1 - e / max(len(x), len(y)) / 2)
    return best
