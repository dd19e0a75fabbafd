"""Personal data replaced by keyed surrogates.

Detected entities get replacements of their own kind: digits become digits,
letters become letters of the same script and case, separators stay; card
numbers that pass the check digit keep passing it, address octets stay in
range, mail addresses get a reserved domain, and name parts become invented
names of the same script, first names with the ending of their title's gender.
The replacement is a function of a secret key and the entity alone, so the same
entity gets the same surrogate in every document, and a surname alone refers to
the same person as the full name.

A person is found behind a title, or as a given name of ``GIVEN`` before a
surname; every further mention of a found name part in the same document, with
or without a title, is replaced by the same surrogate. Key words (``password``
and the like) count in any case. Not found: persons with neither a title nor a
listed given name, and names of one word without a title.

Distinct entities keep distinct surrogates: all entities of the corpus are
gathered once, and where two share a surrogate, or a surrogate is itself an
entity of the corpus, all but the smallest try the next one until no two agree.
The surrogates of mail addresses, names, phone numbers, social security numbers
and secrets get longer with the attempts, so the search ends however many
entities share a shape; the other kinds have 2 ** 32 surrogates and more.
Only these exceptions travel back to the documents.

Defined cases: a null or empty text stays as it is (null becomes empty) with no
entities; null ids and repeated rows are rows like any other, with equal
replacements for equal texts; a very long text is handled whole; an empty table
gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

import hmac
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, stash, table, two_columns
from .tokens import text_slices

KEY = b"replace this key"        # callers pass their own
EXCEPTIONS_BROADCAST = 500_000
SLICE_CHARS = 4_000_000

# titles with the gender they tell; fixed lists
MALE = "Mr|Herr|Señor|Sr|Monsieur|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|госпожа"
OPEN = "Dr|Prof"
NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w])(?P<card>\d(?:[ -]?\d){12,18})(?![\w])"
    r"|(?<![\w])(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?![\w])"
    r"|(?<![\w])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![\w])"
    r"|(?<![\w.+-])(?P<grouped>(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}|0\d(?:[ .-]\d{2}){4}|00[1-9]\d{0,2}(?:[ .-]\d{2,8}){2,5}"
    r"|(?=(?:\d[ /-]?){8})0\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,8}){0,3})(?!\w|[.-]\d)"
    r"|(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_+/-]{16,})"
    rf"|(?<![\w])(?:(?P<male>{MALE})|(?P<female>{FEMALE})|{OPEN})\.? (?P<person>{NAME}(?: {NAME})?)")
# what a text needs to hold any of them: a digit, "@", a key word or a title
HINT = re.compile(rf"\d|@|(?i:token|secret|passw|api)|(?:{MALE}|{FEMALE}|{OPEN})[. ]")
# given names that are no common words or places, with the gender they tell
GIVEN = dict.fromkeys(
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Joshua "
    "Kenneth Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon "
    "Benjamin Samuel Gregory Alexander Patrick Dennis Tyler Aaron Adam Henry Nathan Peter Zachary Kyle Noah Ethan Walter Hans Klaus Jürgen "
    "Wolfgang Dieter Stefan Andreas Markus Matthias Jan Lukas Felix Pierre Jean Jacques Michel Philippe Carlos José Juan Luis Miguel Pedro "
    "Antonio Manuel Marco Giovanni Giuseppe Paolo Ivan Dmitri Sergei Ahmed Mohammed Muhammad Omar Ali Hassan Raj Arjun Wei "
    "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Пётр Владимир Борис".split(), "m") | dict.fromkeys(
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna "
    "Michelle Carol Amanda Dorothy Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Kathleen Amy Angela Shirley Anna Ann Anne Brenda "
    "Pamela Emma Nicole Helen Samantha Katherine Christine Rachel Carolyn Janet Catherine Maria Heather Diane Ruth Julie Olivia Joyce Alice "
    "Jane Julia Sophie Sophia Claire Marie Nathalie Isabelle Sabine Petra Monika Ursula Ingrid Heike Lena Carmen Lucía Ana Elena Giulia "
    "Fatima Aisha Priya Olga Natasha Irina Анна Мария Елена Ольга Наталья Ирина Татьяна Екатерина".split(), "f")
RUN = re.compile(rf"{NAME}(?: {NAME})*")
KINDS = ("email", "ip", "ssn", "card", "phone", "iban", "secret", "person")

_LATIN = ["ba", "le", "mi", "no", "ru", "sa", "te", "vo", "ka", "di", "fe", "gu", "ha", "jo", "pi", "ze"]
_CYRILLIC = ["ба", "ле", "ми", "но", "ру", "са", "те", "во", "ка", "ди", "фе", "гу", "ха", "жо", "пи", "зе"]
_ENDING = {("latin", "m"): "n", ("latin", "f"): "a", ("latin", ""): "er",
           ("cyrillic", "m"): "н", ("cyrillic", "f"): "а", ("cyrillic", ""): "ер"}


class Stream:
    """Numbers drawn from a keyed hash of the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.name, self.block, self.bytes = key, f"{kind}\0{entity}\0{attempt}".encode("utf-8", "surrogatepass"), 0, []

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes = list(hmac.digest(self.key, self.name + bytes([self.block % 256]), "sha256"))
            self.block += 1
        return int.from_bytes([self.bytes.pop() for _ in range(4)], "big") % n


def _shaped(text: str, s: Stream) -> str:
    """The same shape: digits for digits, letters for letters."""
    out = []
    for c in text:
        if c.isascii() and c.isdigit():
            out.append(str(s.below(10)))
        elif c.isascii() and c.isalpha():
            out.append(chr((97 if c.islower() else 65) + s.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _letters(n: int, s: Stream) -> str:
    return "".join(chr(97 + s.below(26)) for _ in range(n))


def _digits(n: int, s: Stream) -> str:
    return "".join(str(s.below(10)) for _ in range(n))


def _check_digit_holds(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def surrogate(kind: str, entity: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The ``attempt``-th surrogate of an entity."""
    s = Stream(key, kind, entity, attempt)
    if kind == "email":
        return _shaped(entity.split("@")[0], s) + _letters(attempt, s) + f"@mail{s.below(10)}.example.org"
    if kind == "ip":
        return ".".join(str(s.below(256)) for _ in range(4))
    if kind == "card":
        out = _shaped(entity, s)
        if _check_digit_holds(re.sub(r"\D", "", entity)):
            out = next(out[:-1] + str(d) for d in range(10) if _check_digit_holds(re.sub(r"\D", "", out[:-1] + str(d))))
        return out
    if kind == "phone" and entity.startswith("+"):
        code = re.match(r"\+\d{1,3}", entity)[0]
        return code + _shaped(entity[len(code):], s) + _digits(attempt // 4, s)
    if kind == "iban":
        return entity[:2] + _shaped(entity[2:], s)
    if kind.startswith("name"):
        script = "cyrillic" if re.search("[А-яЁё]", entity) else "latin"
        parts = _CYRILLIC if script == "cyrillic" else _LATIN
        n = 2 + min(2, len(entity) // 5) + attempt // 8
        return ("".join(parts[s.below(16)] for _ in range(n)) + _ENDING[script, kind[5:]]).capitalize()
    more = {"phone": _digits, "ssn": _digits, "secret": _letters}.get(kind)
    return _shaped(entity, s) + (more(attempt // 4, s) if more else "")


def _direct(text: str):
    """The mentions that show by their own form or a title."""
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if m["person"] is None:
            yield m.start(kind), m.end(kind), "phone" if kind == "grouped" else kind, m[kind]
            continue
        gender = "m" if m["male"] else "f" if m["female"] else ""
        at = m.start("person")
        parts = m["person"].split(" ")
        for k, part in enumerate(parts):
            yield at, at + len(part), "name-" + ((gender or GIVEN.get(part, "")) if k < len(parts) - 1 else ""), part
            at += len(part) + 1


def _capitalised(text: str) -> list[list[tuple[int, str]]]:
    """Runs of capitalised whole words, one blank apart, with their places."""
    runs = []
    for m in RUN.finditer(text):
        at, run = m.start(), []
        for part in m[0].split(" "):
            run.append((at, part))
            at += len(part) + 1
        # the ends of a longer word are no names
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            del run[0]
        if run and m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_"):
            del run[-1]
        if run:
            runs.append(run)
    return runs


def mentions(text: str):
    """(start, end, kind, entity) of what is replaced, in order; a person's
    parts are entities of their own (the last one is the surname), wherever
    they stand in the text."""
    found = list(_direct(text)) if HINT.search(text) else []
    names: dict[str, str] = {}
    for _, _, kind, entity in found:
        if kind.startswith("name"):
            names.setdefault(entity, kind)
    runs = _capitalised(text)
    for run in runs:
        given = False
        for k, (_, part) in enumerate(run):
            if part in GIVEN and k < len(run) - 1:
                names.setdefault(part, "name-" + GIVEN[part])
                given = True
            elif given:
                names.setdefault(part, "name-")
                given = False
    if names:
        starts = [m[0] for m in found]
        for run in runs:
            for at, part in run:
                if part in names:
                    k = bisect_left(starts, at + len(part))
                    if not k or found[k - 1][1] <= at:
                        found.append((at, at + len(part), names[part], part))
        found.sort()
    yield from found


def entities(docs: DataFrame) -> DataFrame:
    """The distinct (kind, entity) of a (doc_id, text) frame."""

    def find(batches):
        for _, texts in text_slices(batches, SLICE_CHARS):
            found = {(kind, entity) for t in texts for _, _, kind, entity in mentions(t)}
            rows = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows], ["kind", "entity"])

    return docs.mapInArrow(find, "kind string, entity string").distinct()


def resolve(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, attempt, surrogate) with distinct surrogates per kind,
    none of them an entity of the corpus."""

    def draw(batches):
        for batch in batches:
            kind, entity, attempt = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(*x, key) for x in zip(kind, entity, attempt)], pa.string())],
                                             ["kind", "entity", "attempt", "surrogate"])

    shape = "kind string, entity string, attempt int, surrogate string"
    real = found.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("taken"))
    now = stash(found.withColumn("attempt", F.lit(0)).mapInArrow(draw, shape), "surrogates")
    while True:
        owners = now.groupBy("kind", "surrogate").agg(F.min("entity").alias("owner"), F.count("*").alias("n"))
        owners = owners.join(real, ["kind", "surrogate"], "left").where("n > 1 or taken")
        owners = stash(owners, "clashes")
        if not owners.limit(1).count():
            return now
        judged = now.join(owners, ["kind", "surrogate"], "left").withColumn(
            "again", F.coalesce(F.col("taken") | (F.col("entity") != F.col("owner")), F.lit(False)) & F.col("owner").isNotNull())
        again = judged.where("again").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, shape)
        now = stash(judged.where("not again").select(*now.columns).unionByName(again), "surrogates")


def replace_private(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """One row per input row: doc_id, the text with surrogates, and the number
    of replacements in all and by kind."""
    docs = two_columns(df, id_col, text_col)
    found = stash(entities(docs), "entities")
    odd = stash(resolve(found, key).where("attempt > 0").select("kind", "entity", "attempt"), "exceptions")
    rows = docs.withColumn("exceptions", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    if odd.limit(1).count():
        def of_doc(batches):
            for ids, texts in text_slices(batches, SLICE_CHARS):
                got = [(d, t, kind, e) for d, t in zip(ids, texts) for kind, e in {m[2:] for m in mentions(t)}]
                c = list(zip(*got)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.string()) for x in c[1:])],
                                                 ["doc_id", "text", "kind", "entity"])
        by_text = (docs.mapInArrow(of_doc, "doc_id long, text string, kind string, entity string")
                   .select(F.xxhash64("text").alias("_text"), "kind", "entity")
                   .join(broadcast_up_to(odd, EXCEPTIONS_BROADCAST), ["kind", "entity"])
                   .groupBy("_text").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("exceptions")))
        rows = (docs.withColumn("_text", F.xxhash64("text"))
                .join(broadcast_up_to(stash(by_text, "exceptions-by-text"), EXCEPTIONS_BROADCAST), "_text", "left")
                .select("doc_id", "text", "exceptions"))

    def write(batches):
        for batch in batches:
            out, counts = [], {k: [] for k in KINDS}
            for text, special in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                attempts = {(x["kind"], x["entity"]): x["attempt"] for x in special or ()}
                parts, end, n = [], 0, dict.fromkeys(KINDS, 0)
                for a, b, kind, entity in mentions(text):
                    parts += [text[end:a], surrogate(kind, entity, attempts.get((kind, entity), 0), key)]
                    end = b
                    n["person" if kind.startswith("name") else kind] += 1
                out.append("".join([*parts, text[end:]]) if parts else text)
                for k in KINDS:
                    counts[k].append(n[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array([sum(c) for c in zip(*counts.values())], pa.int64()),
                 *(pa.array(c, pa.int64()) for c in counts.values())],
                ["doc_id", "text", "n_replaced", *(f"n_{k}" for k in KINDS)])

    return rows.mapInArrow(write, "doc_id long, text string, n_replaced long, " + ", ".join(f"n_{k} long" for k in KINDS))


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_private(table(spark, sf_dir, "documents"))
