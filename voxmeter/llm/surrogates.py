"""Personal data: keyed surrogates in place of detected entities.

Emails, phone numbers, card and account numbers, IP addresses, keys, tokens, passwords
and names after titles, with their later mentions without one, are found by pattern. A surrogate has the type, format, script and
gender of what it stands for and follows from a secret key and the entity alone, so one
entity has one surrogate in all documents. Letters and digits are permuted within their
own classes by a keyed Feistel network: distinct entities of a format get distinct
surrogates. All surrogates are then checked against each other and against all entities
found; those that clash are drawn again until none does. A card number counts by its check
digit. Masks without a letter or digit hide nothing and are no entities.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import cut
from voxmeter.llm.components import other_key

# Titles by gender, fixed values.
MALE = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Sr", "Señor", "Don", "Signor", "господин", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Sra", "Señora", "Srta", "Doña", "Signora", "госпожа", "г-жа"]
NEUTRAL = ["Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Dott", "доктор"]
#: Titles that are also written small; others would be common words.
SMALL = ["mr", "mrs", "ms", "dr", "prof", "herr", "frau", "señor", "señora", "monsieur", "madame"]
GIVEN = {
    "m": ["Adrian", "Bruno", "Carl", "Dario", "Emil", "Fabian", "Gustav", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Martin", "Nils", "Oscar", "Pablo"],
    "f": ["Alba", "Bianca", "Clara", "Daria", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karla", "Lucia", "Marta", "Nora", "Olga", "Paula"],
    "n": ["Alex", "Ariel", "Billie", "Casey", "Charlie", "Dominique", "Eden", "Jamie", "Jordan", "Kim", "Lou", "Morgan", "Noel", "Robin", "Sam", "Sasha"],
}
SYLLABLES = {"latin": ["ba", "den", "fi", "gor", "han", "jo", "kel", "lin", "mar", "nov", "pe", "ros", "sil", "tan", "ver", "wil"], "cyrillic": ["ба", "ден", "фи", "гор", "хан", "жо", "кел", "лин", "мар", "нов", "пе", "рос", "сил", "тан", "вер", "вил"]}
#: Turns after which a format counts as exhausted: each further turn adds a character to the stand-in.
WIDER = 3
TURNS = 24
WORD = r"[^\W\d_]"
NAME = rf"{WORD}[\w'’-]*"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{6,8})(?!\w)"),
    "ip6": re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "key": re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9-]{16,}"),
    "secret": re.compile(r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)\s*[=:]\s*[\"']?([^\s\"']{6,})"),
}
#: Secrets said in other ways; what follows "is" must have a digit.
SAID = [
    re.compile(r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)\s+is:?\s+[\"']?((?=[^\s\"']*\d)[^\s\"']{5,}[^\s\"'.,;:!?)])"),
    re.compile(r"(?i:\bbearer)\s+((?=[\w.~+/-]*\d)[\w.~+/-]{15,}[\w~+/-]=*)"),
]
TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL + SMALL, key=len, reverse=True))})\.?\s+((?=[^\W\d_a-zа-я]){NAME}(?:\s+(?=[^\W\d_a-zа-я]){NAME})?)")
#: A text without these has no entity but for names.
HINT = re.compile(r"[@\d]|::|[Bb]earer|[Pp]ass|[Tt]oken|[Ss]ecret|[Kk]ey|PASS|TOKEN|SECRET|KEY|pwd|gh[pousr]_|sk-|xox")
ORDER = ["email", "secret", "key", "iban", "ip", "ip6", "phone", "ssn", "card"]


def gender(title: str) -> str:
    own = title.rstrip(".").lower()
    return "m" if any(own == t.lower() for t in MALE) else "n" if any(own == t.lower() for t in NEUTRAL) else "f"


def bare(name: str) -> str:
    """A name without the ending of a possessive."""
    return re.sub(r"(?:['’]s|['’-]+)$", "", name)


def counts(kind: str, value: str) -> bool:
    """Whether what a pattern found is an entity."""
    if kind == "email":
        return any(map(str.isalnum, value.partition("@")[0]))
    if kind == "secret":
        return any(map(str.isalnum, value))
    if kind == "ip6":
        # Shorter ones are also scopes and times.
        return any(map(str.isdigit, value)) and len(re.findall(r"\w+", value)) >= 3
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return digits[0] in "23456" and luhn(digits) == 0
    return True


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, apart and in order; on overlap the kind first in ORDER counts."""
    starts: list[int] = []
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        i = bisect_right(starts, start)
        if (not i or found[i - 1][1] <= start) and (i == len(starts) or starts[i] >= end):
            starts.insert(i, start)
            found.insert(i, (start, end, kind))

    if HINT.search(text):
        for kind in ORDER:
            if kind == "email" and "@" not in text:
                continue
            for pattern in (PATTERNS[kind], *(SAID if kind == "secret" else ())):
                for m in pattern.finditer(text):
                    span = m.span(1 if kind == "secret" else 0)
                    if counts(kind, text[slice(*span)]):
                        add(*span, kind)
    known: dict[str, set[tuple[str, str]]] = defaultdict(set)  # first word -> names that begin with it, and their kinds
    for m in TITLED.finditer(text):
        sex, words = gender(m[0].split()[0]), list(re.finditer(NAME, m[1]))
        at = m.start(1)
        for k, w in enumerate(words):
            name, kind = bare(w[0]), "family" if k == len(words) - 1 else f"given-{sex}"
            add(at + w.start(), at + w.start() + len(name), kind)
            if len(name) >= 3:
                known[re.match(r"\w+", name)[0]].add((name, kind))
    if known:  # mentions without a title
        for m in re.finditer(r"\w+", text):
            for name, kind in sorted(known.get(m[0], ()), key=lambda x: (-len(x[0]), x[1])):
                end = m.start() + len(name)
                if text.startswith(name, m.start()) and not re.match(r"\w", text[end : end + 1]):
                    add(m.start(), end, kind)
    return found


def canonical(kind: str, value: str) -> str:
    """What is the same entity in several spellings."""
    if kind in ("email", "family") or kind.startswith("given"):
        return value.lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    return re.sub(r"[ .()/-]", "", value) if kind in ("phone", "card", "iban", "ssn") else value


def draw(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest())


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network on the next even number of bits, walked until it falls inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(8):
            a, b = b, a ^ (draw(key, tweak, r, b) & mask)
        x = a << half | b
        if x < size:
            return x


@lru_cache(maxsize=10_000)
def alike(c: str) -> str:
    """The characters that may stand for a letter or digit: those of its case in ASCII, else of its kind among its 64 neighbours; none for other characters."""
    for own in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in own:
            return own
    kind = unicodedata.category(c)
    if c.isascii() or kind[0] != "L" and kind != "Nd":
        return ""
    return "".join(x for k in range(ord(c) // 64 * 64, ord(c) // 64 * 64 + 64) if unicodedata.category(x := chr(k)) == kind)


def shuffled(value: str, key: bytes, tweak: str, fixed: int = 0, alphabet: str | None = None) -> str:
    """Letters and digits to such as are alike (or characters of ``alphabet`` among themselves), the rest and the first ``fixed`` characters as they are; a permutation of the values of one format."""
    sets = ["" if i < fixed else alphabet if alphabet and c in alphabet else alike(c) for i, c in enumerate(value)]
    size, x = 1, 0
    for c, own in zip(value, sets, strict=True):
        if own:
            size, x = size * len(own), x * len(own) + own.index(c)
    if size == 1:
        return value
    shape = "".join(f"{len(own)}{own[0]}" if own else c for c, own in zip(value, sets, strict=True))
    x, out = permuted(x, size, key, f"{tweak} {shape}"), list(value)
    for i in range(len(value) - 1, -1, -1):
        if sets[i]:
            x, k = divmod(x, len(sets[i]))
            out[i] = sets[i][k]
    return "".join(out)


def luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def surrogate(kind: str, entity: str, key: bytes, turn: int = 0) -> str:
    """The stand-in for an entity in its canonical spelling; ``turn`` is raised after a clash."""
    tweak, wide = f"{kind} {turn}", "0" * max(0, turn - WIDER)
    if kind == "email":
        local, _, domain = entity.partition("@")
        name, _, top = domain.rpartition(".")
        return f"{shuffled(local + wide, key, tweak)}@{shuffled(name, key, 'domain')}.{top}"
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, entity.split("."))))
        while True:
            x = permuted(x, 1 << 32, key, tweak)
            if 1 <= x >> 24 <= 223 and x >> 24 != 127:
                return ".".join(map(str, x.to_bytes(4)))
    if kind == "ip6":
        return shuffled(entity, key, tweak, fixed=4, alphabet="0123456789abcdef")
    if kind == "phone":
        return shuffled(entity + wide, key, tweak, fixed=2 if entity.startswith("+") else 1 if entity.startswith("0") else 0)
    if kind == "card":
        # The rest modulo ten stays, so a valid number gives a valid one.
        body = shuffled(entity[:-1] + wide, key, tweak, fixed=1)
        return body + str((luhn(entity) - luhn(body + "0")) % 10)
    if kind == "iban":
        return shuffled(entity + wide, key, tweak, fixed=2)
    if kind == "key":
        return shuffled(entity + wide, key, tweak, fixed=4)
    if kind == "secret":
        return shuffled(entity + wide, key, tweak, alphabet="0123456789abcdef" if re.fullmatch("[0-9a-f]+", entity) else None)
    if kind == "ssn":
        return shuffled(entity + wide, key, tweak)
    x = draw(key, tweak, entity)
    cyrillic = bool(re.search("[а-яё]", entity))
    if kind.startswith("given") and not cyrillic and x % 16 != 15:
        return GIVEN[kind[-1]][x // 16 % 16].lower() + "".join(SYLLABLES["latin"][x >> (8 + 4 * k) & 15] for k in range(turn))
    parts = SYLLABLES["cyrillic" if cyrillic else "latin"]
    ending = {"given-m": "о" if cyrillic else "o", "given-f": "а" if cyrillic else "a"}.get(kind, "")
    return "".join(parts[x >> (8 + 4 * k) & 15] for k in range(3 + turn)) + ending


def spelled(kind: str, original: str, stand_in: str) -> str:
    """The surrogate in the original's spelling: its punctuation, its case."""
    if kind in ("phone", "card", "iban", "ssn"):
        rest = iter(stand_in)
        return "".join([*(c if c in " .()/-" else next(rest) for c in original), *rest])
    if kind == "ip6":
        return ipaddress.IPv6Address(stand_in).compressed
    if kind == "email":
        return stand_in.upper() if original.isupper() else stand_in
    if kind == "family" or kind.startswith("given"):
        return stand_in.upper() if original.isupper() and len(original) > 1 else stand_in[0].upper() + stand_in[1:]
    return stand_in


def detect_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, text) to (th, kind, entity), each once per text."""
    for batch in batches:
        rows = [(h, kind, e) for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (s := t.as_py()) for kind, e in {(k, canonical(k, s[a:b])) for a, b, k in entities(s)}]
        if rows:
            h, kind, entity = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(kind), pa.array(entity)], names=["th", "kind", "entity"])


def assign_task(key: bytes):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [surrogate(k, e, key, t) for k, e, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["kind", "entity", "turn", "stand_in"])

    return task


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, turn, stand_in): no two entities of a kind share a stand-in, and no stand-in is an entity that was found.

    Stand-ins of an exhausted format are longer; after ``TURNS`` turns they get the entity's
    hash behind them.
    """
    rows = cut(found.select("kind", "entity").distinct().withColumn("turn", F.lit(0)).mapInArrow(assign_task(key), "kind string, entity string, turn int, stand_in string"))
    for turn in range(TURNS + 1):
        taken = rows.groupBy("kind", "stand_in").agg(F.min("entity").alias("owner"), F.count("*").alias("n"))
        real = rows.select("kind", F.col("entity").alias("stand_in")).withColumn("real", F.lit(True))
        bad = taken.join(real, ["kind", "stand_in"], "left").where((F.col("n") > 1) | F.col("real")).select("kind", "stand_in", F.when(F.col("real"), None).otherwise(F.col("owner")).alias("owner"))
        clash = cut(rows.join(bad, ["kind", "stand_in"]).where(F.col("owner").isNull() | (F.col("entity") != F.col("owner"))).select("kind", "entity", "turn"))
        if clash.isEmpty():
            return rows
        again = clash.withColumn("turn", F.col("turn") + 1).mapInArrow(assign_task(key), "kind string, entity string, turn int, stand_in string")
        if turn == TURNS:
            again = again.withColumn("stand_in", F.concat("stand_in", F.lower(F.hex(F.xxhash64("entity", F.lit(key.hex()))))))
        rows = cut(rows.join(clash.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity", "turn", "stand_in").unionByName(again))
    return rows


def replace_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, pairs) to (doc_id, text, n_entities, kinds)."""
    for batch in batches:
        texts, counts, kinds = [], [], []
        for text, pairs in zip(batch.column(1), batch.column(2), strict=True):
            s, known = text.as_py(), {(p["kind"], p["entity"]): p["stand_in"] for p in pairs.as_py() or ()}
            own = entities(s) if known else []
            parts, at = [], 0
            for a, b, kind in own:
                parts += [s[at:a], spelled(kind, s[a:b], known[(kind, canonical(kind, s[a:b]))])]
                at = b
            texts.append("".join([*parts, s[at:]]) if own else s)
            counts.append(len(own))
            kinds.append(sorted({k.split("-")[0] for _, _, k in own}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "text", "n_entities", "kinds"])


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds of every row.

    ``key`` is secret: who has it can find out what a surrogate stands for. Null and empty texts stay as they are with no entities; texts of any length are read
    whole; repeated rows and equal texts change alike; null ids are fine; other columns are
    ignored; an empty table gives no rows. Texts without entities come back unchanged.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    found = cut(rows.select("th", "text").mapInArrow(detect_task, "th long, kind string, entity string").distinct())
    pairs = assigned(found, key).select(F.xxhash64("entity", "kind").alias("k"), "kind", "entity", "stand_in")
    own = found.withColumn("k", F.xxhash64("entity", "kind")).join(pairs, ["k", "kind", "entity"])
    of_text = own.groupBy("th").agg(F.collect_list(F.struct("kind", "entity", "stand_in")).alias("pairs")).select(other_key("th").alias("tk"), "pairs")
    joined = rows.withColumn("tk", other_key("th")).join(of_text, "tk", "left").select("doc_id", "text", "pairs")
    return joined.mapInArrow(replace_task, "doc_id long, text string, n_entities long, kinds array<string>")
