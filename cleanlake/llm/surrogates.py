"""PII surrogates: detected entities get keyed replacements of the same type that keep gender, script and format.

A surrogate is a function of (key, type, normal form of the entity, attempt), so an entity has one surrogate in the whole corpus,
however it is written. All entities start at attempt 0; surrogates that two entities share, or that are themselves entities of the
corpus, are found by grouping, and those entities go to their next attempt until none clashes. Only entities past attempt 0 have
to be known when texts are rewritten: few, since the spaces are large. They are broadcast when a count proves them few and joined to
their texts otherwise.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.llm.common import BROADCAST_ROWS, arrow_rows, stored

KEY = b"surrogates"       # the secret is a parameter; this one is for tests
EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+")
NUMBERS = re.compile(r"(?<![\w.,])(?:\+\d|\(\d|\d)[\d().\- /]*\d(?![\w@])")
PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4}")
ACCOUNT = re.compile(r"\d{13,19}|\d{4}(?:([ -])\d{4})(?:\1\d{4}){2}")
SOCIAL = re.compile(r"\d{3}-\d{2}-\d{4}")
#: Numbers of a fixed shape inside a longer run, and phones with a country code between them.
SHAPES = re.compile(r"(?<!\d)(?:(?P<account>\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?:(?P=s)\d{4}){2})|(?P<social>\d{3}-\d{2}-\d{4})|(?P<ip>(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.\d))"
                    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}(?P<d>[.-])\d{3}(?P=d)\d{4})))(?!\d)")
ABROAD = re.compile(r"(?<!\d)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Honorifics by gender ("" fits any), with the names that follow them. Fixed values.
HONORIFICS = {"m": ["Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Κύριος"],
              "f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Dame", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Doña", "Signora", "Госпожа", "Κυρία"],
              "": ["Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор"]}
GENDER = {x: g for g, xs in HONORIFICS.items() for x in xs}
_ANY = "|".join(HONORIFICS[""])
_WORD = rf"(?!(?:{_ANY})(?!\w))[^\W\d_a-zа-яα-ω][^\W\d_]+"
NAME = re.compile(rf"(?<!\w)(?:(?:(?:{_ANY})\.? )*({'|'.join(HONORIFICS['m'] + HONORIFICS['f'])})\.? (?:(?:{_ANY})\.? )*|(?:(?:{_ANY})\.? )+)({_WORD}(?:[ -]{_WORD}){{0,2}})")
TOKEN = re.compile(r"\w+")
#: Given names by script and gender. Fixed values.
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Vera"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Григорий", "Дмитрий", "Иван", "Максим", "Николай", "Павел", "Сергей"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Софья"],
    ("greek", "m"): ["Αλέξανδρος", "Γεώργιος", "Δημήτρης", "Ιωάννης", "Κώστας", "Νικόλαος", "Πέτρος", "Στέφανος"],
    ("greek", "f"): ["Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
#: Syllables and endings of made-up names by script; endings by gender. Fixed values.
SYLLABLES = {"latin": ["bal", "cor", "den", "fal", "gor", "hal", "jen", "kar", "lin", "mar", "nor", "pel", "ros", "sal", "tor", "ver"],
             "cyrillic": ["бал", "вер", "гор", "дан", "зел", "кор", "лен", "мар", "нов", "пол", "рос", "сол", "тар", "чер"],
             "greek": ["βασ", "γαλ", "δημ", "καλ", "λαμ", "μαν", "νικ", "παπ", "ροδ", "σταθ", "τσιμ", "χαρ"]}
ENDINGS = {("latin", "m"): "o", ("latin", "f"): "a", ("latin", ""): "sen", ("cyrillic", "m"): "ий", ("cyrillic", "f"): "ия", ("cyrillic", ""): "ов",
           ("greek", "m"): "ος", ("greek", "f"): "ία", ("greek", ""): "ίδης"}


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def script(word: str) -> str:
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 or 0x1F00 <= first < 0x2000 else "latin"


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text, in order and without overlap. Names give one entity per word.

    A person is found by an honorific; names that no honorific of the text introduces are not detected."""
    if not text:
        return []
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() >= 7:
            found += _number(m[0], m.start())
    found += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in IBAN.finditer(text) if _iban(m[0].replace(" ", ""))]
    if any(x in text for x in GENDER):
        found += _names(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """The words of names after honorifics, and every other mention of these words in the text that begins with a capital.

    A word alone is a surname if it ends a name of the text, else a given name; inside a full name it is what it is there. A given
    name after titles of any gender alone takes the gender that the text gives it elsewhere.
    """
    said, at_title = [], []
    for m in NAME.finditer(text):
        said.append((tuple(re.split("[ -]", m[2].lower())), GENDER.get(m[1], "")))
        at_title.append(m.start(2))
    if not said:
        return []
    gender, full, alone = {}, {}, {}
    for words, g in said:
        for w in words[:-1]:
            gender[w] = gender.get(w) or g
    for words, g in sorted(said, key=lambda x: x[1] == ""):
        kinds = [f"given-{script(w)}-{g or gender[w]}" for w in words[:-1]] + [f"surname-{script(words[-1])}"]
        full.setdefault(words[0], {}).setdefault((words, g), kinds)
        alone[words[-1]] = kinds[-1]
        for w, kind in zip(words, kinds[:-1]):
            alone.setdefault(w, kind)
    titled = {at: x for at, x in zip(at_title, said)}
    tokens = [(m.start(), m.end(), m[0].lower()) for m in TOKEN.finditer(text) if m[0][0].isupper()]
    out, i = [], 0
    while i < len(tokens):
        start, _, w = tokens[i]
        names = [(titled[start], full[w][titled[start]])] if start in titled else sorted(full.get(w, {}).items(), key=lambda x: -len(x[0][0]))
        for (words, _), kinds in names:
            run = tokens[i: i + len(words)]
            if len(words) > 1 and tuple(x[2] for x in run) == words and all(re.fullmatch(r"[\s-]+", text[a[1]: b[0]]) for a, b in zip(run, run[1:])) or start in titled:
                out += [(*x[:2], kind, x[2]) for x, kind in zip(run, kinds)]
                i += len(words)
                break
        else:
            if w in alone:
                out.append((*tokens[i][:2], alone[w], w))
            i += 1
    return out


def _number(s: str, at: int) -> list[tuple[int, int, str, str]]:
    """Entities of a run of digits, blanks and slashes: every group between slashes is judged, as a whole or by the numbers in it."""
    out = []
    for m in re.finditer(r"[+(\d][\d().\- ]*\d", s):
        t, place = m[0], at + m.start()
        whole = [k for k, rx in (("account", ACCOUNT), ("social", SOCIAL), ("phone", PHONE)) if rx.fullmatch(t)]
        if whole:
            out.append((place, at + m.end(), whole[0], re.sub(r"\D", "", t)))
            continue
        # Numbers of a fixed shape first: a phone with a country code and free groups is looked for in the gaps they leave, or it would take a part of them.
        gap = 0
        for p in [*SHAPES.finditer(t), None]:
            out += [(place + gap + q.start(), place + gap + q.end(), "phone", re.sub(r"\D", "", q[0])) for q in ABROAD.finditer(t[gap: p.start() if p else len(t)])]
            if p:
                gap = p.end()
                if p.lastgroup != "ip":
                    out.append((place + p.start(), place + gap, p.lastgroup, re.sub(r"\D", "", p[0])))
                elif all(int(x) < 256 for x in p[0].split(".")):
                    out.append((place + p.start(), place + gap, "ip", p[0]))
    return out


def _iban(s: str) -> bool:
    return len(s) >= 15 and int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1


class _Draw:
    """An endless keyed stream of small numbers."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed, self.n, self.pool = hmac.new(key, f"{kind}\0{norm}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0, 0
        self.pool = int.from_bytes(self.seed, "big")
        self.left = 256

    def below(self, n: int) -> int:
        if self.left < 64:
            self.n += 1
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), "big")
            self.left = 256
        self.left -= 32
        self.pool, x = divmod(self.pool, 1 << 32)
        return x * n >> 32


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The normal form of the replacement: same type, length and classes of characters; names keep script and gender."""
    d = _Draw(key, kind, norm, attempt)
    classes = lambda s: "".join(chr(97 + d.below(26)) if x.isalpha() else str(d.below(10)) if x.isdigit() else x for x in s)
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        top = labels[-1] if labels[-1] in ("com", "net", "org") else "com"
        extra = "".join(chr(97 + d.below(26)) for _ in range(attempt // 4))     # more room where a format is crowded
        return f"{classes(local)}{extra}@{'.'.join([*map(classes, labels[:-2]), 'example', top])}"
    if kind == "ip":
        parts = [10 if attempt < 8 else 1 + d.below(223), d.below(256), d.below(256), 1 + d.below(254)]
        return str(ipaddress.IPv4Address(bytes(parts)))
    if kind == "iban":
        body = norm[:2] + "00" + "".join(str(d.below(10)) if x.isdigit() else chr(65 + d.below(26)) for x in norm[4:])
        check = 98 - int("".join(str(int(x, 36)) for x in body[4:] + body[:4])) % 97
        return f"{body[:2]}{check:02d}{body[4:]}"
    if kind in ("phone", "account", "social"):
        keep = max(len(norm) - 10, 0) if kind == "phone" else 1 if kind == "account" else 0
        body = norm[:keep] + "".join(str(2 + d.below(8)) if i == 0 and kind == "phone" else str(d.below(10)) for i in range(len(norm) - keep))
        if kind == "account" and luhn(norm) != luhn(body):
            body = next(b for x in range(1, 11) if luhn(b := body[:-1] + str((int(body[-1]) + x) % 10)) == luhn(norm))
        return body
    role, written, *gender = kind.split("-")
    gender = gender[0] if gender else ""
    if role == "given" and attempt == 0:
        pool = GIVEN[written, gender] if gender else GIVEN[written, "m"] + GIVEN[written, "f"]
        return pool[d.below(len(pool))].lower()
    syllables = SYLLABLES[written]
    return "".join(syllables[d.below(len(syllables))] for _ in range(2 + attempt // 2)) + ENDINGS[written, gender]


def written_like(original: str, kind: str, new: str) -> str:
    """The surrogate in the way the original is written: digits in its places, its case."""
    if kind in ("phone", "account", "social", "iban"):
        left = iter(new)
        return "".join(next(left) if x.isalnum() else x for x in original)
    if original.isupper() and len(original) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if kind.startswith(("given", "surname")) and original[:1].isupper() else new


def rewrite(text: str | None, key: bytes, later) -> tuple[str | None, int]:
    """The text with all entities replaced, and their number. later: attempts of entities past attempt 0 by (type, normal form)."""
    out, at, found = [], 0, detect(text)
    for start, end, kind, norm in found:
        out += [text[at:start], written_like(text[start:end], kind, surrogate(key, kind, norm, later.get((kind, norm), 0)))]
        at = end
    return ("".join([*out, text[at:]]) if found else text), len(found)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, norm) of all texts, combined in each task before they are shuffled."""
    def find(frames):
        for f in frames:
            got = {x[2:] for t in f["text"] for x in detect(t)}
            yield pd.DataFrame(sorted(got), columns=["kind", "norm"])
    return docs.select(c(text_col).cast("string").alias("text")).mapInPandas(find, "kind string, norm string").distinct()


def assign(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, norm, attempt, surrogate of every entity; surrogates of a kind are distinct and none is an entity of the corpus."""
    def draw(frames):
        for f in frames:
            yield f.assign(surrogate=[surrogate(key, k, n, a) for k, n, a in zip(f["kind"], f["norm"], f["attempt"])])

    schema = "kind string, norm string, attempt int, surrogate string"
    found = stored(found, "pii-entities")
    real = found.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
    table = stored(found.withColumn("attempt", F.lit(0)).mapInPandas(draw, schema), "pii-assigned")
    while True:
        # Of the entities that share a surrogate the one that has tried least often stays, so that a settled one is not unsettled.
        holders = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("holder"), F.count(F.lit(1)).alias("n"))
        clash = holders.join(real, ["kind", "surrogate"], "left").where("n > 1 or real")
        clash = stored(clash.select("kind", "surrogate", F.when(F.col("real").isNull(), F.col("holder.norm")).alias("stays")), "pii-clashes")
        if clash.isEmpty():
            return table
        marked = table.join(clash.withColumn("hit", F.lit(True)), ["kind", "surrogate"], "left").withColumn("moves", F.col("hit").isNotNull() & ~F.col("norm").eqNullSafe(F.col("stays")))
        moved = marked.where("moves").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")).mapInPandas(draw, schema)
        table = stored(marked.where("not moves").select("kind", "norm", "attempt", "surrogate").unionByName(moved), "pii-assigned")


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: bytes = KEY, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text, n_entities, changed of every row of docs, with all entities replaced.

    Null and empty texts stay as they are. Rows that repeat an identifier are rows of their own; equal texts become equal texts.
    No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(c(id_col).alias("doc_id"), c(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_entities int, changed boolean"
    with arrow_rows(spark, 1000):
        later = stored(assign(entities(rows), key).where("attempt > 0").select("kind", "norm", "attempt"), "pii-later")

    def apply(frames, of):
        for f in frames:
            got = [rewrite(t, key, m) for t, m in zip(f["text"], of(f))]
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": [x[0] for x in got], "n_entities": [x[1] for x in got], "changed": [x[0] != t for x, t in zip(got, f["text"])]})

    few = later.limit(max_rows + 1).collect()
    if len(few) <= max_rows:
        known = spark.sparkContext.broadcast({(r["kind"], r["norm"]): r["attempt"] for r in few})
        with arrow_rows(spark, 1000):
            return rows.mapInPandas(lambda frames: apply(frames, lambda f: [known.value] * len(f)), schema)

    def mentions(frames):
        for f in frames:
            yield pd.DataFrame([(h, *x) for h, t in zip(f["at"], f["text"]) for x in {y[2:] for y in detect(t)}], columns=["at", "kind", "norm"])

    keyed = rows.withColumn("at", F.sha2(F.coalesce("text", F.lit("")), 256))     # a text's replacement depends on the text alone
    with arrow_rows(spark, 1000):
        said = stored(keyed.mapInPandas(mentions, "at string, kind string, norm string").distinct().join(later, ["kind", "norm"])
                      .groupBy("at").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("later")), "pii-mentions")
    of = lambda f: [{(x["kind"], x["norm"]): x["attempt"] for x in m} if m is not None else {} for m in f["later"]]
    return keyed.join(said, "at", "left").select("doc_id", "text", "later").mapInPandas(lambda frames: apply(frames, of), schema)
