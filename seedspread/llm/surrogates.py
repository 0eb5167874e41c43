"""Surrogates for personal data: keyed, type-consistent, distinct, the same for every mention.

Detected are e-mail addresses, phone numbers, payment card numbers (Luhn), IPv4
addresses, secrets (keys, tokens, passwords) and persons after a form of address; the full and family
names so found are names in the whole document.  A
mention's entity is its normal form: separators and upper case don't make another one.

The surrogate is drawn from HMAC-SHA256 of a secret key over kind, entity and attempt, and
is of its kind: an address has an address's parts (equal domains get equal ones, digits
stay digits), a phone number keeps country code and (in its first two attempts) length, a card its first digit and a
valid check digit, an IP address its octets, a secret its character classes; a name its
gender (form of address), script and number of parts, each part replaced alike wherever it occurs.
A mention's own format is then put on: separators, capitals.

Collision checks: all entities of the corpus, the domains of addresses too, are drawn up, and an entity whose surrogate
is another entity's, or is itself an entity of the corpus, is drawn again (the smallest
entity keeps a shared surrogate) until none is left.  Every task can draw a
first attempt by itself, so only entities of later attempts, some in a million, need to be
told: they are broadcast up to ``TOLD`` rows; above, they go to their documents by a join.

Defined cases: a null text stays null and has no mention; an empty text stays empty;
overlapping finds go to the leftmost, then to the longest, then to the kind named first above; equal texts get
equal results.  Added columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedspread.llm.common import col, forget, slices, written

#: Entities of later attempts that are broadcast at most.
TOLD = 100_000
#: Attempts after which surrogates get longer by one, and the growth from which an IP address gets a version 6 one.
GROWS, LONG_IP = 2, 4

#: Forms of address and the gender they tell.
ADDRESS = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Señorita", "г-жа", "Госпожа", "Κα", "Κυρία"],
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н", "Господин", "Κος", "Κύριος"],
    "n": ["Dr", "Prof"],
}
#: Syllables of invented names, and their endings by gender, by script.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi ga go ha he ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi za zo".split(), {"f": ["na", "la", "ra", "ia"], "m": ["n", "s", "ro", "k"], "n": ["l", "n", "r", "ne"]}),
    "cyrillic": ("ба бе бо ва ве ви га да де ди за зо ка ко ла ле ли ма ме ми на не ни но па ра ре ри ро са се си та те ти то".split(), {"f": ["на", "ла", "ра", "ия"], "m": ["н", "р", "слав", "к"], "n": ["ль", "нь", "р", "ко"]}),
    "greek": ("βα βε γα δα δη ζα θα θε κα κο λα λε λι μα με μι να νε νι πα πε ρα ρο σα σι τα τε το φα".split(), {"f": ["να", "λα", "ρα", "ια"], "m": ["νος", "ρος", "λης", "κης"], "n": ["λ", "ν", "ρ", "κο"]}),
}
#: What doesn't end an unquoted secret, and the signs that short secrets get.
CLOSING, SIGNS = ".,;:)]}\\", "!#$%*+-./?@^_~"
_TITLES = {t: g for g, titles in ADDRESS.items() for t in titles}
_HINTS = tuple(sorted({t[:2] for t in _TITLES}))
_NAME = r"[A-ZÀ-ÖØ-ÞŁŚŠŽŻČА-ЯЁΑ-ΩΆΈΉΊΌΎΏ][^\W\d_]*+(?:(?!['’]s(?!\w))['’-][^\W\d_]++)*+"
_WORD = re.compile(rf"(?<!\w){_NAME}")
_PIECE = re.compile(r"[^\W\d_]+")
_KINDS: dict[str, re.Pattern] = {
    "email": re.compile(r"(?<![\w.%+-])[\w%+-][\w.%+-]*+@[\w-]++(?:\.[\w-]++)++"),
    "secret": re.compile(
        r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:(?<![a-z])(?:token|password|secret|api[_-]?key))(?:\\?[\"'])?\s*+[=:]=?>?\s*+"
        r"(?:(?P<quote>[\"'`])(?P<quoted>(?:\\[^\n]|(?!(?P=quote))[^\\\n])++)(?P=quote)|(?:\\?[\"'`])?(?:(?i:bearer|basic)[ \t]++)?(?P<value>(?:[^\s\"'`<>,;&]|[,;&](?![\w.-]++[\"']?\s{0,3}[=:])){8,}+))"
    ),
    "phone": re.compile(
        r"(?<![\w+])\+\d{1,3}[ \xa0.-]?(?:\(\d{1,4}\)|\d{2,4}|\d(?=(?:[ \xa0.-]?\d{2,4}){3}))(?:[ \xa0.-]?\d{2,4}){1,6}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
        r"|(?<![\w(])\(0\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w|[.,]\d)"
        r"|(?<![\w.,+/-])(?:1[.-])?\d{3}([.-])\d{3}\1\d{4}(?!\w|[.,/-]\d)"
        r"|(?<![\w.,+:/-])(?!\d\d([ .-])\d\d\2\d{4}(?!\d))(?!\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))0\d{1,4}(?:(?:[ \xa0-]\d{2,4}){2,4}|(?:\.\d{2,4}){2,4}|[ /-]\d{5,8})(?!\w|[.,:/-]\d|[ \xa0]\d)"
    ),
    "card": re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]|[ -]\d)"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"),
    "person": re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(map(re.escape, _TITLES), key=len, reverse=True))})\.?[ \t](?P<value>{_NAME}(?:[ \t]{_NAME}){{0,2}})"),
}

PERSON = list(_KINDS).index("person")


def luhn(digits: str) -> bool:
    """Whether the last of a card number's digits is its check digit."""
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def script(word: str) -> str:
    first = ord(word[0])
    return "greek" if 0x370 <= first < 0x400 else "cyrillic" if 0x400 <= first < 0x530 else "latin"


def _bare(text: str, persons: list[list[tuple]]) -> Iterator[list[tuple]]:
    """Mentions without a form of address of family names found with one, and of the given names found that stand before them."""
    families, given = {}, {}
    for *first, last in persons:
        families[last[3]] = last[2]
        for x in first:
            given.setdefault((x[3], last[3]), x[2])
            given.setdefault(x[3], x[2])
    words = [m.span() for m in _WORD.finditer(text)]
    for k, (a, b) in enumerate(words):
        whole = text[a:b].lower() in families
        for x, y in [(a, b)] if whole else [(a + m.start(), a + m.end()) for m in _PIECE.finditer(text[a:b])]:
            family = text[x:y].lower()
            if family not in families or not text[x].isupper():
                continue
            parts, j = [(x, y, families[family], family)], k - 1
            while j >= 0 and x == a and text[words[j][1] : parts[0][0]].isspace():
                name = text[slice(*words[j])].lower()
                kind = given.get((name, family)) or given.get(name)
                if not kind:
                    break
                parts.insert(0, (*words[j], kind, name))
                j -= 1
            yield parts


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, entity)`` of each find, in order and apart.

    The entity of a name is one per part: kind ``given`` or ``family`` with gender and script.
    """
    if not text:
        return []
    digits = re.search(r"\d", text)
    found: list[tuple[int, int, int, list]] = []
    for order, (kind, pattern) in enumerate(_KINDS.items()):
        if (kind == "email" and "@" not in text) or (kind in ("phone", "card", "ip") and not digits) or (kind == "person" and not any(h in text for h in _HINTS)):
            continue
        for m in pattern.finditer(text):
            a, b = next((m.span(g) for g in ("value", "quoted") if g in pattern.groupindex and m[g]), m.span())
            if kind == "secret" and m["value"]:
                b = a + len(m["value"].rstrip(CLOSING))
            value = text[a:b]
            if kind == "email":
                parts = [(a, b, kind, value.lower())]
            elif kind == "phone":
                number = re.sub(r"[^\d+]", "", value)
                parts = [(a, b, kind, number)] if value[0] in "+(" or 9 <= len(number) <= 12 else []
            elif kind == "card":
                number = re.sub(r"\D", "", value)
                parts = [(a, b, kind, number)] if luhn(number) else []
            elif kind == "ip":
                octets = [int(x) for x in value.split(".")]
                parts = [(a, b, kind, ".".join(map(str, octets)))] if max(octets) < 256 else []
            elif kind == "secret":
                parts = [(a, b, kind, value)] if (m["quoted"] and value.strip()) or len(value) >= 8 else []
            else:
                words = [(a + w.start(), a + w.end()) for w in re.finditer(_NAME, value)]
                gender = _TITLES[m["title"]]
                parts = [(x, y, f"{'family' if k == len(words) - 1 else 'given'}:{gender if k < len(words) - 1 else 'n'}:{script(text[x:y])}", text[x:y].lower()) for k, (x, y) in enumerate(words)]
            if parts:
                found.append((a, order, b, parts))
    named = [x for x in found if x[1] == PERSON]
    found += [(parts[0][0], len(_KINDS), parts[-1][1], parts) for parts in (_bare(text, [x[3] for x in named]) if named else [])]
    out, at = [], 0
    for a, _, b, parts in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        if a >= at:
            out += parts
            at = b
    return out


class Draw:
    """Numbers below given bounds, drawn from the key, the kind, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.what, self.block, self.pool, self.size = key, f"{kind}\0{entity}\0{attempt}".encode(), 0, 0, 0

    def __call__(self, bound: int) -> int:
        while self.size < bound << 32:
            digest = hmac.new(self.key, self.what + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.size, self.block = self.pool << 256 | int.from_bytes(digest, "big"), max(1, self.size) << 256, self.block + 1
        self.pool, out = divmod(self.pool, bound)
        self.size //= bound
        return out


def _word(draw: Draw, letters: int, gender: str = "n", kind: str = "latin", more: int = 0) -> str:
    syllables, endings = SYLLABLES[kind]
    body = "".join(syllables[draw(len(syllables))] for _ in range(max(3, min(8, letters // 2)) + more))
    return body + endings[gender][draw(len(endings[gender]))]


def _like(value: str, draw: Draw) -> str:
    """Another string of the same character classes; hexadecimal ones stay hexadecimal.

    Signs and escapes stay where there are eight letters and digits; else signs are drawn too, and a short value grows to eight.
    """
    hexadecimal = re.fullmatch(r"[0-9a-f]+", value)
    signs = sum(map(str.isalnum, value)) < 8
    letter = lambda: "abcdef"[draw(6)] if hexadecimal else chr(ord("a") + draw(26))

    def other(c: str) -> str:
        if c.isdigit():
            return str(draw(10))
        if c.isalpha():
            return chr(ord("A") + draw(26)) if c.isupper() else letter()
        return c if c.isspace() or not signs else SIGNS[draw(len(SIGNS))]

    out = [x if x[0] == "\\" and not signs else other(x[-1]) for x in re.findall(r"(?s)\\.|.", value)]
    return "".join(out + [letter() for _ in range(8 - sum(not x.isspace() for x in out))])


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, of_domain: int = 0) -> str:
    """What stands for an entity, in normal form; an address has its domain's surrogate of the attempt ``of_domain``.

    Later attempts add syllables or digits, so that a class with more entities than short surrogates settles too.
    """
    draw, more = Draw(key, kind, entity, attempt), attempt // GROWS
    digits = lambda n: "".join(str(draw(10)) for _ in range(n))
    if kind == "email":
        local = entity.rpartition("@")[0]
        pieces = "".join(_word(draw, len(p)) if p[0].isalpha() else "".join(str(draw(10)) if c.isdigit() else c for c in p) for p in re.findall(r"[^\W\d_]+|[\W\d_]+", local))
        return f"{pieces}{digits(more)}@{surrogate(key, 'domain', domain(entity), of_domain)}"
    if kind == "domain":  # longer from attempt to attempt, so that there are enough
        return f"{_word(draw, 8 + 2 * attempt, 'n', 'latin', more)}.example.{('com', 'net', 'org')[Draw(key, 'ending', entity, attempt)(3)]}"
    if kind == "phone":
        country = re.match(r"\+(?:1|7|\d{2})|0", entity)
        fixed = country.group() if country else ""
        rest = len(entity) - len(fixed) + more
        return fixed + "".join(str(2 + draw(8)) if k == 0 else str(draw(10)) for k in range(rest))
    if kind == "card":
        body = entity[0] + "".join(str(draw(10)) for _ in entity[1:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "ip":
        if more >= LONG_IP:
            return "2001:db8:" + ":".join(f"{draw(1 << 16):x}" for _ in range(6))
        return ".".join(str(n) for n in (11 + draw(115), draw(256), draw(256), 1 + draw(254)))
    if kind == "secret":
        return "AKIA" + _like(entity[4:], draw) if re.fullmatch(r"AKIA[0-9A-Z]{16}", entity) else _like(entity, draw) + digits(more)
    part, gender, letters = kind.split(":")
    return _word(draw, len(entity), gender if part == "given" else "n", letters, more)


def dressed(value: str, kind: str, mention: str) -> str:
    """A surrogate in the format of a mention: its separators and capitals."""
    if kind in ("phone", "card"):
        fill = iter(value.lstrip("+"))
        return "".join(next(fill, "") if c.isdigit() else c for c in mention) + "".join(fill)
    if kind == "email":
        return value.upper() if mention.isupper() else value
    if ":" in kind:
        return value.upper() if mention.isupper() and len(mention) > 1 else value.capitalize()
    return value


def rewrite(text: str | None, key: bytes, attempts: Mapping[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and kind, start and end of each in it."""
    out, spans, at, length = [], [], 0, 0
    for a, b, kind, entity in mentions(text):
        of_domain = [attempts.get(("domain", domain(entity)), 0)] if kind == "email" else []
        new = dressed(surrogate(key, kind, entity, attempts.get((kind, entity), 0), *of_domain), kind, text[a:b])
        out += [text[at:a], new]
        length += a - at
        spans.append({"kind": kind.partition(":")[0], "start": length, "end": length + len(new)})
        length += len(new)
        at = b
    return (text if not out else "".join([*out, text[at:]])), spans


def domain(address: str) -> str:
    return address.rpartition("@")[2]


def known_in(text: str | None) -> list[tuple[str, str]]:
    """The distinct ``(kind, entity)`` of a text; the domain of an address is one of its own."""
    found = {(kind, entity) for _, _, kind, entity in mentions(text)}
    return sorted(found | {("domain", domain(entity)) for kind, entity in found if kind == "email"})


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct ``(kind, entity)`` of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = sorted({x for text in batch.column(0).to_pylist() for x in known_in(text)})
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.string()) for k in range(2)], names=["kind", "entity"])

    return docs.select(col(text_col).alias("text")).mapInArrow(run, "kind string, entity string").distinct()


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """Adds the surrogate of each ``(kind, entity, attempt, of_domain)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = [surrogate(key, *(x if x[3] else x[:3])) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "entity", "attempt", "of_domain", "surrogate"])

    return rows.select("kind", "entity", "attempt", "of_domain").mapInArrow(run, "kind string, entity string, attempt int, of_domain int, surrogate string")


def assigned(known: DataFrame, key: bytes) -> DataFrame:
    """``(kind, entity, attempt, surrogate)``: of one class (names: one gender and script) no two surrogates are equal, and none is an entity.

    Addresses come after the domains, as their surrogates hold those of the domains.
    """
    first = _settled(known.where("kind <> 'email'").withColumn("of_domain", F.lit(0)), key)
    domains = first.where("kind = 'domain' and attempt > 0").select(F.col("entity").alias("domain"), F.col("attempt").alias("of_domain"))
    mails = known.where("kind = 'email'").withColumn("domain", F.substring_index("entity", "@", -1)).join(domains, "domain", "left")
    then = _settled(mails.select("kind", "entity", F.coalesce("of_domain", F.lit(0)).alias("of_domain")), key)
    return first.unionByName(then).drop("of_domain")


def _settled(known: DataFrame, key: bytes) -> DataFrame:
    """The last attempt of each ``(kind, entity, of_domain)``, when nothing collides any more."""
    now = written(_drawn(known.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:  # ends, as surrogates grow with the attempt
        owners = now.groupBy("kind", "surrogate").agg(F.min("entity").alias("owner"))
        real = known.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        marked = now.join(owners, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = written(marked.where(F.col("real") | (F.col("owner") != F.col("entity"))).select("kind", "entity", (F.col("attempt") + 1).alias("attempt"), "of_domain"), "clashes")
        if clash.isEmpty():
            forget(clash)
            return now
        rest = now.join(clash.select("kind", "entity"), ["kind", "entity"], "left_anti")
        after = written(rest.unionByName(_drawn(clash, key)), "surrogates")
        forget(now)
        forget(clash)
        now = after


def replaced(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, their number ``n_private`` (long) and their ``spans`` (kind, start, end) in the new text."""
    known = written(entities(docs, text_col), "entities")
    later = written(assigned(known, key).where("attempt > 0").select("kind", "entity", "attempt"), "later-attempts")
    added = [T.StructField("n_private", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
    keep = [c for c in docs.columns if c not in {f.name for f in added}]
    rows = docs.select(*[col(c) for c in keep])
    told = later.count() <= TOLD
    if told:
        attempts = {(r.kind, r.entity): r.attempt for r in later.collect()}
        rows = rows.withColumn("_s_own", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        attempts = {}
        rows = _with_own(rows, later, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(attempts)
    schema = T.StructType([*rows.schema.fields[:-1], *added])
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = ({(x["kind"], x["entity"]): x["attempt"] for x in o} if o else shared.value for o in batch.column(len(keep)).to_pylist())
            new = [rewrite(t, key, o) for t, o in zip(batch.column(at).to_pylist(), own, strict=True)]
            columns = [pa.array([t for t, _ in new], pa.string()) if k == at else batch.column(k) for k in range(len(keep))]
            spans = pa.array([s for _, s in new], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for _, s in new], pa.int64()), spans], names=schema.names)

    return rows.mapInArrow(run, schema)


def _with_own(rows: DataFrame, later: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds to each document the attempts of those of its entities that have later ones, joined by the documents' ids and text hashes."""
    key = {"_s_id": col(id_col), "_s_t1": F.xxhash64(F.lit(1), col(text_col)), "_s_t2": F.xxhash64(F.lit(2), col(text_col))}
    keyed = rows.withColumns(key)
    narrow = keyed.select(*key, col(text_col).alias("text"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("kind", T.StringType()), T.StructField("entity", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(k, x) for k, t in enumerate(batch.column(3).to_pylist()) for x in known_in(t)]
            owner = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(owner) for c in range(3)], *[pa.array([x[k] for _, x in found], pa.string()) for k in range(2)]], names=schema.names)

    own = narrow.mapInArrow(run, schema).join(later, ["kind", "entity"]).groupBy(*key).agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("_s_own"))
    same = F.col("l._s_id").eqNullSafe(F.col("r._s_id")) & (F.col("l._s_t1") == F.col("r._s_t1")) & (F.col("l._s_t2") == F.col("r._s_t2"))
    return keyed.alias("l").join(own.alias("r"), same, "left").select(*[F.col(f"l.`{c}`") for c in rows.columns], "_s_own")
