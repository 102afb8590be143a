"""Surrogates for personal data and secrets.

Detected entities get keyed replacements of their own type.  A surrogate
keeps the shape of what it replaces: digits become digits, letters become
letters of the same script and case, separators stay; a card number that
passes the Luhn check still does, an address part stays an octet, a given
name becomes one of the same gender and script.

* Coreference: the replacement hangs on the key, the type and the normal form
  (case, separators and titles do not count), so all mentions of an entity in
  all documents get the same one, each in the format of its own mention.  A
  given name has one gender in the corpus (``one_gender``), and where a text
  names somebody, the parts of the name standing alone are mentions too.
* Distinctness: all entities of the corpus are checked together, given names
  and surnames as one type.  Where two of one type got the same surrogate, or
  a surrogate is a real entity, all but one take the next attempt until none
  collide.  Late attempts add
  characters, so a small space (a two-letter address) cannot run out.

A first pass finds the entities of every text.  A second one joins the texts
with their entities' surrogates by (id, hash of the text) and replaces them;
texts without entities pass untouched.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import discard, no_tables, quoted, written

#: Attempts that keep the exact shape; later ones add characters.
IN_SHAPE = 6

# Titles, given names by script and gender, letters by script.
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа", "Κυρία"]
TITLES_M = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
TITLES_ANY = ["Dr", "Prof", "Professor"]
GIVEN = {
    ("latin", "f"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Margaret", "Catherine", "Victoria", "Julia", "Sophie", "Claudia", "Gabriela"],
    ("latin", "m"): ["James", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Christopher", "Paul", "George", "Philippe", "Jürgen", "Carlos", "Javier"],
    ("cyrillic", "f"): ["Мария", "Анна", "Ольга", "Елена", "Наталья", "Татьяна"],
    ("cyrillic", "m"): ["Иван", "Дмитрий", "Сергей", "Алексей", "Михаил", "Николай"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Σοφία", "Κατερίνα"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"],
}
LETTERS = {
    "latin": ("bcdfghklmnprstvz", "aeiou"),
    "cyrillic": ("бвгдзклмнпрстх", "аеиоу"),
    "greek": ("βγδκλμνπρστφ", "αειου"),
}

_GENDER_OF = {n: g for (_, g), names in GIVEN.items() for n in names}
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]+"
_TITLE = "|".join(map(regex.escape, sorted([*TITLES_F, *TITLES_M, *TITLES_ANY], key=len, reverse=True)))
_GIVEN = "|".join(sorted(_GENDER_OF, key=len, reverse=True))
#: In this order; where matches overlap, the earlier kind stands.
PATTERNS = {
    "email": regex.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "access_key": regex.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "secret": regex.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[A-Za-z0-9+/_-]{8,})"),
    "iban": regex.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip6": regex.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])"),
    "ip": regex.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    "card": regex.compile(r"(?<![0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"),
    "ssn": regex.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone": regex.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9-])"),
    "name": regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:(?P<t>{_TITLE})\.?[ ](?P<v>{_WORD}(?:[ ]{_WORD}){{0,2}})|(?P<v>(?:{_GIVEN})(?:[ ]{_WORD}){{1,2}}))"),
}
_ALONE = regex.compile(r"(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}'’-]+")
#: What can follow a name in its word: a possessive, a quote, a dash.
_TAIL = re.compile(r"(?:['’][sS]|['’-]+)$")
_DIGIT = re.compile("[0-9]")
#: Decimal digits of other scripts than ASCII.
_OTHER_DIGIT = regex.compile(r"(?V1)[\p{Nd}--[0-9]]")
_ASSIGNED = ("password", "passwd", "pwd", "secret", "token", "key")


def luhn(digits: str) -> int:
    """0 for a number that passes the check."""
    odd = [int(d) for d in digits[::-1]]
    return (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10


def plain_digits(text: str) -> str:
    """The text with the decimal digits of all scripts in ASCII, one for one."""
    if text.isascii() or not _OTHER_DIGIT.search(text):
        return text
    return _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m.group())), text)


def digits_like(mention: str, out: str) -> str:
    """``out`` with its digits in the script of the mention's first one."""
    first = next((c for c in mention if c.isdecimal()), "0")
    zero = ord(first) - unicodedata.decimal(first)
    return out if zero == ord("0") else re.sub("[0-9]", lambda m: chr(zero + int(m.group())), out)


def mod97(iban: str) -> int:
    """1 for a number that passes the check of ISO 7064."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _is_ip6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
        return len(value.replace(":", "")) >= 6  # shorter ones are times, names in code, or the local host
    except ValueError:
        return False


def script_of(word: str) -> str:
    c = next((c for c in word if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form), in order, without overlaps.  Each
    part of a name is a mention of its own, so that 'Ms X Y' and 'Ms Y' agree.
    Numbers count in the digits of any script."""
    text = plain_digits(text)
    taken: list[tuple[int, int, str, str]] = []
    used = bytearray(len(text))
    low, digit = text.lower(), _DIGIT.search(text) is not None
    # What each pattern needs, found faster than by the pattern itself.
    able = {
        "email": "@" in text,
        "access_key": "AKIA" in text or "ASIA" in text,
        "secret": any(w in low for w in _ASSIGNED),
        "ip6": text.count(":") > 1,
        "name": True,
    }
    for kind, pattern in PATTERNS.items():
        if not able.get(kind, digit):
            continue
        for m in pattern.finditer(text):
            a, b = m.span("v") if "v" in pattern.groupindex else m.span()
            value = text[a:b]
            if any(used[a:b]):
                continue
            digits = re.sub(r"[^0-9]", "", value)
            if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if kind == "secret" and not digits and (text[a - 1] in " \t\n" or len(set(value)) < 6):
                continue  # prose after a colon
            if kind == "card" and (luhn(digits) or digits[0] not in "23456"):
                continue
            if kind == "iban" and mod97(value.replace(" ", "")) != 1:
                continue
            if kind == "ip6" and not _is_ip6(value):
                continue
            if kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            used[a:b] = b"\1" * (b - a)
            if kind == "name":
                taken += _name_parts(m.groupdict().get("t"), value, a)
            else:
                normal = digits if kind in ("card", "phone", "ssn") else value.lower() if kind in ("email", "ip6") else value.replace(" ", "") if kind == "iban" else value
                taken.append((a, b, kind, normal))
    return sorted(taken)


def _name_parts(title: str | None, value: str, at: int) -> Iterator[tuple[int, int, str, str]]:
    parts = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^ ]+", value)]
    gender = "f" if title in TITLES_F else "m" if title in TITLES_M else _GENDER_OF.get(parts[0][2].title(), "any")
    for i, (a, b, word) in enumerate(parts):
        if i == len(parts) - 1:
            word = _TAIL.sub("", word)
            b = a + len(word)
        given = len(parts) > 1 and i < len(parts) - 1
        # A surname has one surrogate whoever bears it; a given name has its gender's.
        kind = f"given_{gender if gender != 'any' else _GENDER_OF.get(word.title(), 'any')}" if given else "surname"
        yield at + a, at + b, kind, word.casefold()


def role(kind: str) -> str:
    """The type that a name's surrogate hangs on: given names of all genders have one."""
    return "given" if kind.startswith("given_") else kind


def alone(text: str, taken: list[tuple[int, int, str, str]], parts: set[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """Mentions outside those ``taken``, in order: the words that are one of
    ``parts`` ((role, normal form) of the text's names).  One that is both a
    given name and a surname is the first before another part of a name."""
    values = {v for r, v in parts if r in ("given", "surname")}
    if not values:
        return []
    used = bytearray(len(text))
    for a, b, _, _ in taken:
        used[a:b] = b"\1" * (b - a)
    found = []
    for m in _ALONE.finditer(text):
        a, word = m.start(), m.group()
        if word.casefold() not in values:
            word = _TAIL.sub("", word)
        value, b = word.casefold(), a + len(word)
        if value not in values or any(used[a:b]):
            continue
        after = _ALONE.match(text, b + 1) if text[b : b + 1] == " " else None
        first = after is not None and _TAIL.sub("", after.group()).casefold() in values
        kinds = ("given", "surname") if first else ("surname", "given")
        found.append((a, b, next(k for k in kinds if (k, value) in parts), value))
    return found


def stream(key: bytes, *parts: object) -> Iterator[int]:
    """Keyed bytes without end."""
    block = 0
    while True:
        yield from hmac.new(key, "\x1f".join(map(str, (*parts, block))).encode(), hashlib.sha256).digest()
        block += 1


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of a normal form, itself a normal form."""
    s = stream(key, kind, value, attempt)
    longer = max(0, attempt - IN_SHAPE + 1)
    if kind == "ip":
        out = []
        for part in value.split("."):
            low, high = (0, 255) if longer else {1: (0, 9), 2: (10, 99), 3: (100, 255)}[len(part)]
            out.append(str(low + (next(s) << 8 | next(s)) % (high - low + 1)))
        return ".".join(out)
    if kind in ("card", "phone", "ssn"):
        digits = [value[0], *(str(next(s) % 10) for _ in range(len(value) - 1 + longer))]
        if kind == "card" and not luhn(value):
            digits[-1] = "0"
            digits[-1] = str(-luhn("".join(digits)) % 10)
        if kind != "card":
            digits[0] = value[0] if value[0] in "01" else str(2 + next(s) % 8)
        return "".join(digits)
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        # One host has one surrogate host, whatever stands before it.
        return _shaped(local, s) + _extra(s, longer) + "@" + _shaped(host, stream(key, "host", host)) + "." + top
    if kind == "iban":
        body = _shaped(value[4:], s) + "".join(str(next(s) % 10) for _ in range(longer))
        return value[:2] + f"{98 - mod97(value[:2] + '00' + body):02d}" + body
    if kind == "ip6":
        # Groups keep their length and a first digit other than zero; late attempts fill them.
        groups = value.split(":")
        fill = [g if not longer or not g else g.rjust(4, "f") for g in groups]
        return ":".join("".join("0123456789abcdef"[next(s) % 16] if i else "123456789abcdef"[next(s) % 15] for i, _ in enumerate(g)) for g in fill)
    if kind == "access_key":
        return value[:4] + _shaped(value[4:], s) + _extra(s, longer).upper()
    if kind == "secret":
        return _shaped(value, s) + _extra(s, longer)
    return _name(kind, value, attempt, s)


def _extra(s: Iterator[int], n: int) -> str:
    return "".join(chr(97 + next(s) % 26) for _ in range(n))


def _shaped(value: str, s: Iterator[int]) -> str:
    """Digits for digits, letters for letters; hexadecimal stays so."""
    low = "abcdef" if re.fullmatch(r"[0-9a-fA-F]{12,}", value) else "abcdefghijklmnopqrstuvwxyz"
    pick = {"d": "0123456789", "l": low, "u": low.upper()}
    return "".join(pick[k][next(s) % len(pick[k])] if (k := "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "") else c for c in value)


def _name(kind: str, value: str, attempt: int, s: Iterator[int]) -> str:
    script = script_of(value)
    one = ""
    if kind != "surname":
        gender = kind.removeprefix("given_")
        pool = GIVEN[script, gender if gender in "fm" else "fm"[next(s) % 2]]
        one = pool[(next(s) << 8 | next(s)) % len(pool)].casefold()
        if attempt < 4:
            return one if not attempt else one + "-" + pool[(next(s) << 8 | next(s)) % len(pool)].casefold()
        # Past the pairs a made-up second name follows the first, which shows the gender.
        one += "-"
    hard, soft = LETTERS[script]
    word = one + "".join(hard[next(s) % len(hard)] + soft[next(s) % len(soft)] for _ in range(max(3, (len(value) + 1) // 2) + attempt // 4))
    ends = {"cyrillic": ("ова", "ов"), "greek": ("ου", "ος"), "latin": ("", "")}[script]
    female = value.endswith(("ова", "ева", "ина", "ая", "ου"))
    return word + (ends[0] if female else ends[1] if kind == "surname" else "")


def formatted(kind: str, mention: str, normal: str) -> str:
    """The surrogate in the format of this mention."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(normal)
        out = "".join(next(digits, "") if c.isdecimal() else c for c in mention)
        return digits_like(mention, out + "".join(digits))
    if kind == "ip":
        return digits_like(mention, normal)
    if kind == "iban":
        chars = iter(normal)
        out = "".join(c if c == " " else next(chars, "") for c in mention)
        return digits_like(mention, out + "".join(chars))
    if kind == "ip6":
        return digits_like(mention, normal.upper() if mention.isupper() else normal)
    if kind == "email" or role(kind) in ("given", "surname"):
        if mention.isupper():
            return normal.upper()
        if kind == "email":
            return "".join(n.upper() if m.isupper() else n for m, n in zip(mention, normal)) + normal[len(mention) :]
        return "-".join(p[:1].upper() + p[1:] for p in normal.split("-"))
    return normal


def entities_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, kind, value): the distinct entities of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tables()
        for b in batches:
            rows = [(i, *kv) for i, t in enumerate(b.column(2)) for kv in sorted({m[2:] for m in mentions(t.as_py())})]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "text_hash", "kind", "value"],
            )

    docs = df.where(quoted(text).isNotNull()).select(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("text_hash"), quoted(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, kind string, value string")


def _role(kind: Column) -> Column:
    return F.when(kind.startswith("given_"), "given").otherwise(kind)


def one_gender(entities: DataFrame) -> DataFrame:
    """The distinct (kind, value) with one kind for each given name: of the
    one gender that its mentions show, or given_any if they show none or both."""
    seen = [F.max((F.col("kind") == f"given_{g}").cast("int")).alias(g) for g in "fm"]
    one = entities.groupBy(_role(F.col("kind")).alias("role"), "value").agg(*seen)
    gender = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("any")
    return one.select(F.when(F.col("role") == "given", F.concat(F.lit("given_"), gender)).otherwise(F.col("role")).alias("kind"), "value")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate, attempt) for the distinct entities (kind,
    value): within a kind, or all kinds of names, no two surrogates are
    equal, and none is a value of the table.  Each round redoes only what collided in the one before."""
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tables()
        for b in batches:
            made = [surrogate(secret, k, v, n) for k, v, n in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    make = lambda df: df.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")
    now = written(make(entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0))), "pii-map")
    while True:
        # Who has tried least stays, then the smaller value; a real value beats all.
        space = F.when(_role(F.col("kind")).isin("given", "surname"), "name").otherwise(F.col("kind")).alias("space")
        claims = now.select(space, F.col("surrogate").alias("claim"), "attempt", "value", "kind").unionByName(
            now.select(space, F.col("value").alias("claim"), F.lit(-1).alias("attempt"), F.lit("").alias("value"), F.lit("").alias("kind"))
        )
        first = claims.groupBy("space", "claim").agg(F.min(F.struct("attempt", "value", "kind")).alias("w"))
        won = first.where("w.attempt >= 0").select("w.kind", "w.value", F.lit(True).alias("won"))
        judged = now.join(won, ["kind", "value"], "left")
        if not judged.where("won is null").limit(1).count():
            return now
        again = make(judged.where("won is null").withColumn("attempt", F.col("attempt") + 1))
        after = written(judged.where("won").select("kind", "value", "attempt", "surrogate").unionByName(again), "pii-map")
        discard(now)
        now = after


def replace(df: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", counts: str | None = None) -> DataFrame:
    """``df`` with the entities in ``text`` replaced; all other columns and
    all rows, repeated ones too, as they are.  Null and empty texts stay
    null and empty.  ``counts`` names a column to add: entities replaced."""
    found = written(entities_of(df, doc_id, text), "pii-entities")
    mapping = assign(one_gender(found), key)
    by_role = _role(F.col("kind")).alias("kind")
    edits = (
        found.select("doc_id", "text_hash", by_role, "value")
        .distinct()
        .join(mapping.select(by_role, "value", "surrogate"), ["kind", "value"])
        .groupBy("doc_id", "text_hash")  # at most the entities of one text
        .agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("edits"))
    )
    keep = [f for f in df.schema.fields if f.name.lower() != (counts or "").lower()]
    names = [f"c{i}" for i in range(len(keep))]
    flat = df.select(*[quoted(f.name).alias(n) for f, n in zip(keep, names)])
    at = next(i for i, f in enumerate(keep) if f.name.lower() == text.lower())
    key_col = next(n for f, n in zip(keep, names) if f.name.lower() == doc_id.lower())
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for f, n in zip(keep, names)) + ", n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tables()
        for b in batches:
            out, done = [], []
            for t, edits in zip(b.column(at), b.column(b.num_columns - 1)):
                t, n = t.as_py(), 0
                if edits.is_valid:
                    to = {(e["kind"], e["value"]): e["surrogate"] for e in edits.as_py()}
                    parts, end = [], 0
                    named = mentions(t)
                    for a, z, kind, value in sorted(named + alone(t, named, set(to))):
                        parts += [t[end:a], formatted(kind, t[a:z], to[role(kind), value])]
                        end, n = z, n + 1
                    t = "".join([*parts, t[end:]])
                out.append(t)
                done.append(n)
            columns = [*b.columns[:-1], pa.array(done, pa.int32())]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n"])

    joined = flat.withColumn("h", F.xxhash64(names[at])).join(
        edits, F.col(key_col).eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left"
    )
    whole = joined.select(*names, "edits").mapInArrow(run, schema)
    return whole.select(*[F.col(n).alias(f.name) for f, n in zip(keep, names)], *([F.col("n").alias(counts)] if counts else []))
