"""Surrogates for personal data: keyed, type-consistent replacements.

Detected: e-mail addresses, phone numbers, payment cards (Luhn), IPv4 addresses, social security
numbers, IBANs (mod 97), secrets after words such as token or password, and names in three ways: after a title, all capitalised
words that follow it, with initials; a well-known given name (GIVEN) and the capitalised words after it; and two or three capitalised words beside evidence of a person (a verb of
speech, work or meeting, an age, a word that leads to a name), by score. The second and third way take no sequence with a word that makes it a place, an institution or
a thing (NO_PERSONS). Other capitalised mentions of the parts follow, but at the start of a sentence not of words that are common (COMMON, or
in lower case elsewhere in the document) unless a verb of speech, work or meeting follows, and none before such a word. A
name is taken part by part, so that a full name and the bare surname keep referring to the same person. Names without any of
this evidence, social security and phone numbers without separators, and IPv6 addresses are not found.

An entity is (kind, norm): the norm drops case and separators, so every spelling of one entity gets
one surrogate. Kinds of names carry script; the gender of a given name's surrogate comes from all titles it
has in the corpus (none or both: neutral). An initial stays an initial. Candidates come from
HMAC-SHA256 under a secret key; digits stay digits, letters stay letters of their script, separators, case, top-level domain, Luhn and
IBAN check digits stay valid. Collision checks run over all distinct entities of the corpus: a candidate that equals a real entity of its kind, or
another entity's surrogate, is drawn again. Surrogates go back to documents by joins on the entity.

Defined results: null texts stay null; texts without entities are unchanged; equal rows get equal results; an
empty table gives an empty table; all columns are returned, whatever their names, and only the text changes; an entity that two kinds claim
goes to the first in the order above, and of candidates for one surrogate the entity that sorts first wins; texts of any length are read whole, in time that grows as n log n.
"""

from __future__ import annotations

import hashlib
import hmac
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import materialize, text_batches, whole_rows

#: Draws after which a surrogate may be longer than its entity, so that small domains cannot run out.
SAME_LENGTH_DRAWS = 8
MAX_DRAWS = 64
SPANS = "array<struct<start:int,stop:int,kind:string,norm:string>>"

# Titles by gender, and syllables of made-up names by script.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "господин", "г-н", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Señorita", "госпожа", "г-жа", "κυρία"),
    "n": ("Dr", "Prof", "Professor"),
}
SYLLABLES = {
    "latin": ("ba be bo da de do fa fi ga go ha hen ja jo ka ke la le li lo ma mi mo na ne no pa pe ra re ri ro sa se ta te ti to va ve wa wi".split(), {"m": "n s r k".split(), "f": "ia na la ssa".split(), "n": "en is il".split(), "s": "man sen ley wick ford".split()}),
    "cyrillic": ("ба бе ва ве га да де ка ке ла ле ма ми на не ра ре са та ти".split(), {"m": "н р с к".split(), "f": "на ля ра ша".split(), "n": "ен ис".split(), "s": "нко дзе вич".split()}),
    "greek": ("βα γα δα κα λα μα νι πα ρα σα τα φι".split(), {"m": "ος ης ας".split(), "f": "ια να λη".split(), "n": "ιν ορ".split(), "s": "ιδης ακης".split()}),
}
# Given names that tell a person without a title when a capitalised surname follows.
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Paul Andrew Steven Kenneth George Edward Brian Peter Henry Hans Klaus Jürgen Wolfgang Stefan Jean Pierre Jacques François Luis Carlos José Juan Miguel Giovanni Marco Paolo Иван Пётр Сергей Алексей Дмитрий Николай Γιώργος Δημήτρης Νίκος".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Emily Michelle Laura Helen Anna Julia Ursula Monika Sabine Petra Marie Sophie Isabelle Nathalie Carmen Lucía María Elena Giulia Chiara Анна Мария Елена Ольга Наталья Татьяна Μαρία Ελένη Κατερίνα".split(),
}
# Endings of surnames with a form for each gender.
MASCULINE = ("ов", "ев", "ёв", "ин", "ын")
FEMININE = tuple(m + "а" for m in MASCULINE)
#: Words that may stand inside a name, and capitalised words that end one.
PARTICLES = "van von der den de del della di da dos du la le al bin ibn ten ter zu y".split()
NO_NAMES = "and but or who which that this these those then when while after before with from is was are were has had have he she it they we you the not said says also there here".split()
# Capitalised words that make a name one of a place, an institution or a thing.
NO_PERSONS = frozenset(
    "river street city road avenue lane square park lake mountain mountains mount hill hills valley bay beach island islands bridge county state town village harbor harbour creek forest garden gardens airport station tower castle cathedral church abbey "
    "university college school academy institute hospital clinic museum library theatre theater hall house hotel stadium arena centre center court palace memorial monument foundation society association union committee council ministry department agency office bureau bank "
    "prize award medal cup trophy festival day week month act law bill treaty plan project programme program report review journal times post news press magazine award awards championship league conference north south east west northern southern eastern western new "
    "license licence version public general software act agreement copyright page chapter section part volume figure table appendix article company corporation corp inc ltd llc group holdings partners industries systems technologies motors airlines records studios pictures games software bible gospel "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "straße platz fluss stadt universität schule rue avenue place université école ville fleuve calle plaza ciudad universidad escuela río avenida".split()
)
# Words that are names, too.
COMMON = frozenset(
    "will young may mark rose grace hope bill rich frank grant chase brown white green black gray grey king prince price stone wood woods hill hills field fields baker cook gold silver summer winter april june august long short small little strong wise sharp swift "
    "page bush ford lane rivers waters banks power powers love day knight bishop pope church art faith joy dawn rob sue pat drew jack penny ruby amber iris ivy lily violet daisy hunter bond best good hardy noble major french english german "
    "west north south east park parks marsh moss reed rice bell ball bird fox wolf lamb crane drake finch case cash chance childs cross close cole court dean early fair fall flood forest foot gore hand hart head holly house hurt lake law lord moon moody more nice north nations pace paine pitt rain rush sage savage self sky snow speed sparks star steel storm street sun thorn todd town vale wall ward ware wells winds worth".split()
)
# Words that begin sentences and no names.
STARTERS = frozenset(
    "so the a an in on at if as for from by to of but yesterday today tomorrow last next later yes no my our his her its their i some many most all each every only even also now still perhaps maybe however both either because since although though until once again thus hence yet how why what "
    "where whose one two three dear contact ask tell see read please let meanwhile finally then there please in der die das ein eine und le la les un une et el los las una y".split()
)
# Words after a person's name, and words before one.
AFTER_NAME = frozenset(
    "said says say told tells asked asks wrote writes replied replies added answered explained argued claimed noted warned insisted thinks thought believes believed met meets joined joins married loves lives lived works worked moved studied teaches taught signed called calls emailed phoned smiled laughed nodded shrugged sighed whispered shouted resigned retired died".split()
)
BEFORE_NAME = frozenset("by told asked met meet meets called emailed phoned contact contacted named author dear hi hello interviewed married invited hired thanked sincerely regards and".split())
HEX = "0123456789abcdef"
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def script_of(text: str) -> str:
    for ch in text:
        if "\u0370" <= ch <= "\u03ff":
            return "greek"
        if "\u0400" <= ch <= "\u04ff":
            return "cyrillic"
    return "latin"


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + it pass the Luhn check."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{body}{country}00")
    return f"{98 - int(number) % 97:02d}"


@cache
def _patterns():
    import regex

    titles = {t.lower(): g for g, ts in TITLES.items() for t in ts}
    names = "|".join(sorted(map(regex.escape, titles), key=len, reverse=True))
    letters = r"[\p{L}\p{M}]*(?:['’\-][\p{L}\p{M}]+)*"
    part = rf"\p{{Lu}}\.|\p{{Lu}}{letters}"
    return {
        "email": regex.compile(r"[\p{L}\p{N}._%+\-]*[\p{L}\p{N}_]@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}"),
        "secret": regex.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-/+]{12,})"),
        "iban": regex.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
        "ip": regex.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
        "card": regex.compile(r"(?<![\d])\d(?:[ \-]?\d){12,18}(?!\d)"),
        "ssn": regex.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
        "phone": regex.compile(r"(?<![\d+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)"),
        "person": regex.compile(
            rf"(?i:\b(?P<title>{names}))\.?\s+(?:(?i:(?P<title>{names}))\b\.?\s+)*(?P<part>{part})"
            rf"(?:(?:[ \t]+(?:(?:{'|'.join(PARTICLES)})[ \t]+)*|(?<=\.)[ \t\-]*)(?!(?i:{names}|{'|'.join(NO_NAMES)})(?![\p{{L}}\p{{M}}]))(?P<part>{part}))*"
        ),
        "named": regex.compile(
            rf"(?<![\p{{L}}\p{{M}}\p{{N}}_@.\-])(?P<part>{'|'.join(sorted((n for ns in GIVEN.values() for n in ns), key=len, reverse=True))})(?![\p{{L}}\p{{M}}\-])"
            rf"(?:[ \t]+(?:(?:{'|'.join(PARTICLES)})[ \t]+)*(?!(?i:{names}|{'|'.join(NO_NAMES)})(?![\p{{L}}\p{{M}}]))(?P<part>{part}))+"
        ),
        "pair": regex.compile(
            rf"(?<![\p{{L}}\p{{M}}\p{{N}}_@.\-])(?P<part>\p{{Lu}}[\p{{Ll}}\p{{M}}]+(?:['’\-]\p{{Lu}}?[\p{{Ll}}\p{{M}}]+)*)(?:[ \t]+(?:(?:{'|'.join(PARTICLES)})[ \t]+)*(?P<part>\p{{Lu}}[\p{{Ll}}\p{{M}}]+(?:['’\-]\p{{Lu}}?[\p{{Ll}}\p{{M}}]+)*|\p{{Lu}}\.)){{1,2}}(?![\p{{L}}\p{{M}}\-])"
        ),
        "before": regex.compile(r"(\p{L}+),?[ \t]+$"),
        "after": regex.compile(r"[ \t]+(?<verb>\p{Ll}\p{L}*)|,[ \t]+(?:aged[ \t]+)?\d{1,3}\b|[ \t]*\(\d{1,3}\)"),
        "lower": regex.compile(r"(?<![\p{L}\p{M}\p{N}])\p{Ll}[\p{L}\p{M}]*"),
        "verb": regex.compile(r"[ \t]+(\p{Ll}+)"),
        "next": regex.compile(r"[ \t]+(\p{Lu}[\p{L}\p{M}]*)"),
        "capital": regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])\p{{Lu}}{letters}"),
    }, titles


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal())


def _bare(name: str) -> str:
    """A part of a name without the dot of an initial and the ending of a possessive."""
    return name[:-2] if len(name) > 3 and name[-2:] in ("'s", "’s", "'S", "’S") else name.rstrip(".")


def _starts_sentence(text: str, at: int) -> bool:
    before = text[max(0, at - 40) : at].rstrip(" \t\"'“”‘’«»(")
    return not before or before[-1] in ".!?…:;\n\r"


def _before_thing(text: str, end: int) -> bool:
    """Whether the next word makes what stands before it a place, an institution or a thing."""
    m = _patterns()[0]["next"].match(text, end)
    return m is not None and m[1].casefold() in NO_PERSONS


def _acts(text: str, end: int) -> bool:
    """Whether the next word is one that follows a person's name."""
    m = _patterns()[0]["verb"].match(text, end)
    return m is not None and m[1] in AFTER_NAME


#: Evidence from which a sequence of capitalised words is a person.
ENOUGH = 2


def _is_person(text: str, m, unlisted: bool, titles: dict[str, str]) -> bool:
    """Whether a sequence of capitalised words without a title is a person: not with a word of NO_PERSONS in it or after it; one with an unlisted given name needs evidence beside it."""
    parts = [_bare(x).casefold() for x in m.captures("part")]
    if any(x in NO_PERSONS for x in parts) or _before_thing(text, m.end()) or parts[0] in NO_NAMES:
        return False
    if not unlisted:
        return True
    if parts[0] in STARTERS or len(set(parts)) < len(parts) or any(x in titles or x in NO_NAMES for x in parts):
        return False
    p, first = _patterns()[0], m.starts("part")[0]
    before, after = p["before"].search(text, max(0, first - 30), first), p["after"].match(text, m.end())
    led = before is not None and before[1].casefold() in BEFORE_NAME
    acts = after is not None and (after["verb"] is None or after["verb"].casefold() in AFTER_NAME)
    score = 2 * acts + 2 * (led and before[1].casefold() != "and") + (led and before[1].casefold() == "and")
    return score - (_starts_sentence(text, first) and parts[0] in COMMON) >= ENOUGH


def _masculine(norm: str) -> str:
    """The masculine form of a surname that has one for each gender: it names the entity, for families and declined forms."""
    return norm[:-1] if len(norm) > 5 and norm.endswith(FEMININE) else norm


class _Free:
    """Tells whether a span meets none of the given ones, which are sorted and do not overlap."""

    def __init__(self, taken: list[tuple[int, int]]):
        self.taken = taken

    def __call__(self, a: int, b: int) -> bool:
        k = bisect_left(self.taken, (b, b))
        return k == 0 or self.taken[k - 1][1] <= a


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, norm) of the entities of a text, left to right without overlap."""
    if not text:
        return []
    p, titles = _patterns()
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # sorted, without overlap
    free = _Free(taken)

    def add(a: int, b: int, kind: str, norm: str) -> None:
        if free(a, b):
            insort(taken, (a, b))
            found.append((a, b, kind, norm))

    if "@" in text:
        for m in p["email"].finditer(text):
            add(m.start(), m.end(), "email", m[0].lower())
    if ":" in text or "=" in text:
        for m in p["secret"].finditer(text):
            add(m.start(1), m.end(1), "secret", m[1])
    if any(map(text.__contains__, "0123456789")):
        for m in p["iban"].finditer(text):
            v = m[0].replace(" ", "")
            if len(v) >= 15 and iban_check(v[:2], v[4:]) == v[2:4]:
                add(m.start(), m.end(), "iban", v)
        for m in p["ip"].finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                add(m.start(), m.end(), "ip", m[0])
        for m in p["card"].finditer(text):
            v = _digits(m[0])
            if luhn_digit(v[:-1]) == v[-1]:
                add(m.start(), m.end(), "card", v)
        for kind in ("ssn", "phone"):
            for m in p[kind].finditer(text):
                v = _digits(m[0])
                if 9 <= len(v) <= 15:
                    add(m.start(), m.end(), kind, v)
    known: dict[str, str] = {}
    lower: set[str] | None = None  # the words that stand in lower case, where a name is found at all
    given = {n: g for g, ns in GIVEN.items() for n in ns}
    for m in (m for way in ("person", "named", "pair") for m in p[way].finditer(text, overlapped=way == "pair")):
        if m.re is not p["person"] and not _is_person(text, m, m.re is p["pair"], titles):
            continue
        if m.re is p["pair"]:
            gender = given.get(m.captures("part")[0], "n")
        elif m.re is p["person"]:
            gender = next((g for t in m.captures("title") if (g := titles[t.lower()]) != "n"), "n")
            gender = given.get(m["part"] if len(m.captures("part")) == 1 else m.captures("part")[0], "n") if gender == "n" else gender
        else:
            gender = given[m.captures("part")[0]]
        parts = [(x, x + len(n)) for x, y in m.spans("part") if (n := _bare(text[x:y]))]
        last = max((k for k, (x, y) in enumerate(parts) if y - x > 1), default=len(parts) - 1)
        for k, (x, y) in enumerate(parts):
            norm, script = text[x:y].casefold(), script_of(text[x:y])
            kind = f"surname:s:{script}" if k == last else f"given:{gender}:{script}"
            if k == last:
                norm = _masculine(norm)
            if m.re is not p["person"] and norm in known:
                kind = known[norm]
            add(x, y, kind, norm)
            if y - x > 1 and (k == last or norm not in known):
                known[norm] = kind
    if known:
        lower = set(p["lower"].findall(text))
        for m in p["capital"].finditer(text):
            at = m.start()
            whole = _bare(m[0])
            if whole.casefold() in known and (_before_thing(text, m.end()) or (_starts_sentence(text, at) and (whole.casefold() in COMMON or whole.casefold() in lower) and not _acts(text, m.end()))):
                continue
            pieces = [whole] if whole.casefold() in known else whole.split("-")
            for piece in pieces:
                norm = piece.casefold()
                if norm not in known and known.get(_masculine(norm), "").startswith("surname"):
                    norm = _masculine(norm)
                if (kind := known.get(norm)) and piece[:1].isupper() and free(at, at + len(piece)):
                    found.append((at, at + len(piece), kind, norm))
                at += len(piece) + 1
    return sorted(found)


class _Draw:
    """Keyed numbers for one entity and draw."""

    def __init__(self, key: bytes, kind: str, norm: str, draw: int):
        self.seed, self.key, self.n, self.pool = f"{kind}\x1f{norm}\x1f{draw}".encode(), key, 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def surrogate(key: bytes, kind: str, norm: str, draw: int) -> str:
    """The candidate norm of an entity's surrogate at a draw."""
    d = _Draw(key, kind, norm, draw)
    extra = max(0, draw - SAME_LENGTH_DRAWS + 1)
    if kind in ("ssn", "phone"):
        lead = norm[:1] if kind == "phone" else ""
        return lead + d.digits(len(norm) - len(lead) + extra)
    if kind == "card":
        body = norm[0] + d.digits(len(norm) - 2 + extra)
        return body + luhn_digit(body)
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "iban":
        body = "".join(str(d.below(10)) if c.isdecimal() else chr(65 + d.below(26)) for c in norm[4:]) + d.digits(extra)
        return norm[:2] + iban_check(norm[:2], body) + body
    if kind.startswith(("given", "surname")):
        _, gender, script = kind.split(":")
        parts, ends = SYLLABLES[script]
        if gender == "s" and norm.endswith(MASCULINE):
            ends = {"s": MASCULINE}
        return "".join(parts[d.below(len(parts))] for _ in range(2 + draw // 2)) + ends[gender][d.below(len(ends[gender]))]
    stem, tail = norm, ""
    if kind == "email":
        cut = norm.rindex(".")
        stem, tail = norm[:cut], norm[cut:]
    hexed = kind == "secret" and all(c in HEX for c in norm)
    out = []
    for c in stem:
        if hexed:
            out.append(HEX[d.below(16)])
        elif c.isdecimal():
            out.append(str(d.below(10)))
        elif c.isalpha():
            letters = ALPHABETS[script_of(c)]
            x = letters[d.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    fill = [HEX[d.below(16)] for _ in range(extra)]
    return "".join(fill + out) + tail


def render(surface: str, kind: str, norm: str) -> str:
    """The surrogate's norm in the format of the replaced text."""
    if kind in ("ssn", "phone", "card"):
        rest, out = list(norm), []
        for c in surface:
            out.append(rest.pop(0) if c.isdecimal() and rest else c)
        return "".join(out + rest)
    if kind == "iban":
        rest = list(norm)
        return "".join([" " if c == " " else rest.pop(0) for c in surface if c == " " or rest] + rest)
    if kind.startswith(("given", "surname")):
        if len(surface) == 1:
            return norm[:1].upper()
        if kind.startswith("surname") and norm.endswith(MASCULINE) and surface.casefold().endswith(FEMININE):
            norm += "а"
        return norm.upper() if surface.isupper() else norm[:1].upper() + norm[1:]
    if kind == "email" and len(norm) == len(surface):
        return "".join(n.upper() if s.isupper() else n for s, n in zip(surface, norm, strict=True))
    return norm


def _candidates(key: bytes, draw: int):
    @F.pandas_udf("string")
    def make(kind: pd.Series, norm: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, n, draw) for k, n in zip(kind, norm, strict=True)])

    return make


def _domain(kind: Column) -> Column:
    return F.regexp_replace(kind, "^given:[mfn]:", "given:")


def _with_gender(spans: DataFrame) -> DataFrame:
    """Distinct (domain, norm, kind) of spans (kind, norm): a given name is one entity, its gender that of its titles in the corpus."""
    g = spans.groupBy(_domain(F.col("kind")).alias("domain"), "norm").agg(F.max(F.col("kind").startswith("given:m")).alias("m"), F.max(F.col("kind").startswith("given:f")).alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    return g.select("domain", "norm", F.when(F.col("domain").startswith("given:"), F.concat(F.lit("given:"), gender, F.substring("domain", 6, 99))).otherwise(F.col("domain")).alias("kind"))


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, surrogate) for distinct (kind, norm): one surrogate each, no two alike in a kind, none a real entity of it. Given names of all genders count as one kind."""
    entities = materialize(entities.select("kind", "norm").distinct().withColumn("domain", _domain(F.col("kind"))), "entities")
    done, pending = None, entities
    for draw in range(MAX_DRAWS):
        drawn = pending.withColumn("surrogate", _candidates(key, draw)("kind", "norm"))
        real = entities.select(F.col("domain"), F.col("norm").alias("surrogate"))
        free = drawn.join(real, ["domain", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("domain", "surrogate"), ["domain", "surrogate"], "left_anti")
        won = materialize(free.groupBy("domain", "surrogate").agg(F.min(F.struct("norm", "kind")).alias("e")).select("e.kind", "e.norm", "domain", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        pending = materialize(pending.join(won, ["kind", "norm"], "left_anti"), "pending")
        if pending.isEmpty():
            return done.drop("domain")
    raise RuntimeError(f"no free surrogate after {MAX_DRAWS} draws")


def find_entities(rows: DataFrame) -> DataFrame:
    """(__id, __rid, spans) of the texts that hold entities. rows: (__id, __rid, __text)."""
    kind = dict(rows.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))
        for b in batches:
            spans = [detect(x.as_py()) for x in b.column(2)]
            at = [k for k, s in enumerate(spans) if s]
            if at:
                take = pa.array(at)
                values = [[dict(zip(("start", "stop", "kind", "norm"), s, strict=True)) for s in spans[k]] for k in at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(values, schema)], names=["__id", "__rid", "spans"])

    return rows.select("__id", "__rid", "__text").mapInArrow(run, f"__id {kind}, __rid bigint, spans {SPANS}")


def _replace(text: Column, spans: Column) -> Column:
    @F.pandas_udf("string")
    def put(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, spans, strict=True):
            if ss is not None and len(ss):
                parts, at = [], 0
                for s in sorted(ss, key=lambda x: x["start"]):
                    parts += [t[at : s["start"]], render(t[s["start"] : s["stop"]], s["kind"], s["surrogate"])]
                    at = s["stop"]
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return put(text, spans)


def with_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every detected entity of the text column replaced; count_col adds the number of replacements, in place of a column of that name."""
    text_batches(docs)
    rid = F.xxhash64(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("__id"), rid.alias("__rid"), F.col(text_col).alias("__text"))
    found = materialize(find_entities(rows), "pii-spans").dropDuplicates(["__id", "__rid"])
    spans = found.select("__id", "__rid", F.explode("spans").alias("s")).select("__id", "__rid", "s.*")
    names = assign_surrogates(_with_gender(spans), key).withColumn("domain", _domain(F.col("kind")))
    put = spans.withColumn("domain", _domain(F.col("kind"))).drop("kind").join(names, ["domain", "norm"]).groupBy("__id", "__rid").agg(F.collect_list(F.struct("start", "stop", "kind", "surrogate")).alias("__spans"))
    put = put.select(F.col("__id").alias("__d"), F.col("__rid").alias("__r"), "__spans")
    base = whole_rows(docs, __id=F.col(id_col), __rid=rid, __text=F.col(text_col))
    joined = base.join(put, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__rid") == F.col("__r")), "left")
    new = F.when(F.col("__spans").isNull(), F.col("__text")).otherwise(_replace(F.col("__text"), F.col("__spans")))
    columns = [new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c != count_col]
    if count_col:
        columns.append(F.coalesce(F.size("__spans"), F.lit(0)).alias(count_col))
    return joined.select(*columns)
