"""Personal data replaced by keyed surrogates of the same type and format.

A scan finds e-mail addresses, phone, card, social-security and bank account
numbers, IP addresses, credentials and names: behind an honorific, a known given name
or a phrase that introduces a name, and a surname so found wherever else it stands in
that document.  A number of 13 to 19 digits is a card if its check digit fits, or if it
has the first digit and length of one; book numbers (978, 979) are none.

Each mention has a canonical form (digits alone, lower case, ...): mentions of one
canonical form are one entity, whatever document they stand in.  An honorific without a
gender ("Dr") takes the one gender that other mentions of the same name have; where they
have both, or none, it is an entity of its own.  An entity's surrogate is drawn from a
keyed hash: digits become digits, letters become letters of their script, a given name one
of the same gender and script, a valid card or account number a valid one.  Hosts and
surnames are entities too: addresses at one host stay at one host, "Mr Keller" and
"Hugo Keller" keep one surname.  A mention's separators and letter case are then put back.

Collisions are checked over the corpus, first for hosts and surnames, then for all that is
made of them: where two entities of a kind draw one surrogate, or a surrogate is itself an
entity, all but one draw again, until no two entities share a surrogate.  First draws need
no lookup, so only documents that hold a redrawn entity travel to meet the list of redraws.

Defined cases: a null text stays null; a repeated row is replaced as the first is;
null ids are allowed.  The key is a secret of the caller; without it surrogates
can't be traced back, with it they are the same in every run.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usertrail.llm.common import _marked, bounded_batches, column, landed, slices, texts

# Given names by gender and script, and the words that stand before a name.
GIVEN = {
    ("m", "LATIN"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Louis Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("f", "LATIN"): "Alice Berta Clara Diana Emma Flora Greta Helen Ines Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Teresa Vera".split(),
    ("m", "CYRILLIC"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Максим Никита Олег Павел".split(),
    ("f", "CYRILLIC"): "Алиса Вера Галина Дарья Елена Инна Ксения Лидия Мария Нина Ольга София".split(),
    ("m", "GREEK"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Νίκος".split(),
    ("f", "GREEK"): "Άννα Βασιλική Δέσποινα Ελένη Ζωή Κατερίνα Μαρία Σοφία".split(),
}
HONORIFICS = {
    "m": "Mr Mister Herr Señor Sr Monsieur Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Госпожа Κυρία".split(),
    "": "Dr Prof".split(),
}
#: Phrases behind which a name stands.
CUES = ["name is", "Name:", "signed by", "Signed,", "Sincerely,", "Regards,", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle",
        "me llamo", "Me llamo", "меня зовут", "Меня зовут", "με λένε", "Με λένε"]
_GENDER = {name: g for (g, _), names in GIVEN.items() for name in names}
_TITLE_GENDER = {t: g for g, titles in HONORIFICS.items() for t in titles}
_TITLES, _NAMES = "|".join(sorted(_TITLE_GENDER)), "|".join(sorted(_GENDER))
_CAP = r"[^\W\d_a-zß-öø-ÿа-яα-ω][^\W\d_]+"

KINDS = ("email", "secret", "iban", "card", "ssn", "ip", "phone", "name")
_WITH_DIGITS = re.compile("|".join([
    r"(?P<email>[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)+)",
    r"(?P<assign>(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)(?P<secret>[A-Za-z0-9+/_.=\-]{8,})",
    r"\b(?P<iban>[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)\b",
    r"(?<![\w.+])(?P<card>\d(?:[ \-]?\d){12,18})(?![\d])",
    r"(?<![\w.])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w\-])",
    r"(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\d|\.\d)",
    r"(?<!\w)(?P<phone>(?:\+?\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}"
    r"|\d{3}[ .\-]\d{3,4}[ .\-]\d{4})(?!\d)",
]))
_NAME = re.compile(rf"\b(?:(?P<title>{_TITLES})\.?\x20(?P<titled>{_CAP}(?:\x20{_CAP})?)"
                   rf"|(?P<known>(?P<given>{_NAMES})\x20(?!(?P=given)\b){_CAP})"
                   rf"|(?:{'|'.join(CUES)})\s(?P<cued>{_CAP}\x20{_CAP}))\b")
_CAPITAL = re.compile(rf"\b{_CAP}\b")
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_DIGIT = re.compile(r"[0-9]")


# ------------------------------------------------------------------ entities

def canonical(kind: str, value: str) -> str:
    if kind in ("card", "phone", "ssn"):
        return "".join(_DIGIT.findall(value))
    if kind == "iban":
        return value.replace(" ", "")
    if kind in ("email", "name"):
        return value.lower()
    if kind == "ip" and ":" in value:
        return str(ipaddress.ip_address(value))
    return value


def entity(kind: str, value: str, gender: str) -> tuple[str, str, str]:
    """What a mention names: a single word of a name is a surname, which has no gender."""
    canon = canonical(kind, value)
    if kind == "name" and " " not in canon:
        return "surname", canon, ""
    return kind, canon, gender


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def is_card(digits: str) -> bool:
    if len(digits) == 13 and digits[:3] in ("978", "979"):
        return False
    return luhn(digits) or (len(digits) in (15, 16) and digits[0] in "3456")


def is_ip6(value: str) -> bool:
    """Groups that the address grammar allows, at least two of them with digits: no times, no scopes."""
    if sum(any(c.isdigit() for c in g) for g in value.split(":")) < 2:
        return False
    try:
        return ipaddress.ip_address(value).version == 6
    except ValueError:
        return False


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, value, gender) of all entities, in order and without overlap."""
    found = []
    if _DIGIT.search(text) or "@" in text or "=" in text or ":" in text:
        for m in _WITH_DIGITS.finditer(text):
            kind = m.lastgroup
            end = m.end(kind)
            if kind == "email":  # marks behind an address are not its own
                end -= len(m[kind]) - len(m[kind].rstrip(".-_"))
            if kind != "card" or is_card(canonical(kind, m[kind])):
                found.append((m.start(kind), end, kind, text[m.start(kind):end], ""))
        if text.count(":") > 1:
            found += [(m.start(), m.end(), "ip", m[0], "") for m in _IP6.finditer(text) if is_ip6(m[0])]
    surnames = set()
    for m in _NAME.finditer(text):
        kind = "titled" if m["titled"] else "known" if m["known"] else "cued"
        gender = _TITLE_GENDER[m["title"]] if m["title"] else ""
        found.append((m.start(kind), m.end(kind), "name", m[kind], gender or _GENDER.get(m[kind].split(" ")[0], "")))
        surnames.add(m[kind].split(" ")[-1])
    if surnames:
        found += [(m.start(), m.end(), "name", m[0], "") for m in _CAPITAL.finditer(text)
                  if m[0] in surnames or m[0].capitalize() in surnames]
    out, end = [], 0
    for e in sorted(found, key=lambda e: (e[0], -e[1], e)):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


# ------------------------------------------------------------------ draws

class _Stream:
    """Numbers from a keyed hash of what names the entity and the attempt."""

    def __init__(self, key: bytes, *name: str, bits: int = 128):
        seed = int.from_bytes(hashlib.blake2b("\0".join(name[:-1]).encode(), key=key, digest_size=16).digest(), "big")
        # fewer bits make collisions likely, for tests
        self.state = hashlib.sha256(f"{seed % 2**bits}\0{name[-1]}".encode() + key).digest()
        self.pool, self.size = int.from_bytes(self.state, "big"), 2**256

    def below(self, n: int) -> int:
        if self.size < n << 64:
            self.state = hashlib.sha256(self.state).digest()
            self.pool, self.size = int.from_bytes(self.state, "big"), 2**256
        self.pool, got = divmod(self.pool, n)
        self.size //= n
        return got


_LETTERS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}


def script(char: str) -> str:
    found = unicodedata.name(char, "LATIN").split(" ")[0]
    return found if found in _LETTERS else "LATIN"


def _like(text: str, stream: _Stream) -> str:
    """Digits for digits, and letters of the same script and case for letters."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            letters = _LETTERS[script(c)]
            got = letters[stream.below(len(letters))]
            out.append(got.upper() if c.isupper() else got)
        else:
            out.append(c)
    return "".join(out)


def _check_digits(country: str, body: str) -> str:
    """The two digits that make an account number valid: the whole is 1 modulo 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def part(kind: str, canon: str) -> tuple[str, str] | None:
    """The host of an address, the surname of a name."""
    if kind == "email":
        return "host", canon.rsplit("@", 1)[1]
    return ("surname", canon.rsplit(" ", 1)[1]) if kind == "name" else None


def draw(kind: str, canon: str, gender: str, attempt: int, key: bytes, bits: int = 128, of: str | None = None) -> str:
    """The canonical surrogate of an entity at an attempt; ``of``: that of its host or surname, else the first draw."""
    stream = _Stream(key, kind, canon, str(attempt), bits=bits)
    if kind in ("email", "name"):
        of = of or draw(*part(kind, canon), "", 0, key, bits)
    if kind == "email":
        return _like(canon.rsplit("@", 1)[0], stream) + "@" + of
    if kind in ("host", "surname"):  # short ones get longer where many draws collide
        *labels, last = canon.split(".") if kind == "host" else (canon, "")
        labels[0] += labels[0][-1] * (attempt // 6)
        return ".".join([_like(x, stream) for x in labels] + ([last] if kind == "host" else []))
    if kind == "ip" and ":" in canon:
        return re.sub(r"[0-9a-f]+", lambda m: "123456789abcdef"[stream.below(15)] + "".join(
            "0123456789abcdef"[stream.below(16)] for _ in m[0][1:]), canon)
    if kind == "ip":
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "card":
        body = str(1 + stream.below(9)) + "".join(str(stream.below(10)) for _ in canon[2:])
        right = next(d for d in "0123456789" if luhn(body + d))
        return body + (right if luhn(canon) else str((int(right) + 1 + stream.below(9)) % 10))
    if kind == "phone":
        return canon[:1] + _like(canon[1:], stream)  # the country or trunk digit stays
    if kind == "iban":
        body, right = _like(canon[4:], stream), _check_digits(canon[:2], canon[4:])
        return canon[:2] + (_check_digits(canon[:2], body) if canon[2:4] == right else _like(canon[2:4], stream)) + body
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
        digits = "0123456789abcdef" if canon == canon.lower() else "0123456789ABCDEF"
        return "".join(digits[stream.below(16)] for _ in canon)
    if kind == "name":
        given = canon.split(" ")[0]
        names = GIVEN.get((gender or "mf"[stream.below(2)], script(canon[0])))
        # a surname may have more bearers than there are given names
        return f"{names[stream.below(len(names))].lower() if attempt < 6 else _like(given, stream)} {of}"
    return _like(canon, stream)


def render(kind: str, value: str, surrogate: str) -> str:
    """The surrogate in the format of the mention; a numbered one as it is."""
    if surrogate.startswith(f"{kind}-"):
        return surrogate
    if kind in ("card", "phone", "ssn"):
        digits = iter(surrogate)
        return "".join(next(digits) if c in "0123456789" else c for c in value)
    if kind == "iban":
        signs = iter(surrogate)
        return "".join(c if c == " " else next(signs) for c in value)
    if kind == "email":
        return "".join(s.upper() if c.isupper() else s for c, s in zip(value, surrogate)) if len(value) == len(surrogate) else surrogate
    if kind == "name":
        return surrogate.upper() if value.isupper() else surrogate.title()
    if kind == "ip" and ":" in value and value.upper() == value:
        return surrogate.upper()
    return surrogate


def replace(text: str, redrawn: dict[tuple[str, str, str], str], key: bytes, bits: int = 128) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced."""
    out, at, kinds = [], 0, []
    for start, end, kind, value, gender in entities(text):
        named = entity(kind, value, gender)
        surrogate = redrawn.get(named) or draw(*named, 0, key, bits)
        out += [text[at:start], render(kind, value, surrogate)]
        at = end
        kinds.append(kind)
    return "".join(out) + text[at:], kinds


# ------------------------------------------------------------------ the corpus

ROW = ["kid", "no_id", "th"]
ENTITY = ["kind", "canon", "gender"]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return bounded_batches(docs).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("kid"), F.col(key).isNull().alias("no_id"),
                       F.xxhash64(text).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def _text(text: str) -> Column:
    return F.col("doc").getField(text).cast("string")


def mentions(rows: DataFrame, text: str) -> DataFrame:
    """(kid, no_id, th, kind, canon, gender) of each entity in each text, written once."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, found = [], []
            for i, t in enumerate(texts(batch)):
                here = {entity(kind, value, gender) for _, _, kind, value, gender in entities(t)}
                found += sorted(here)
                of += [i] * len(here)
            cols = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([column(batch, c).take(pa.array(of, pa.int64())) for c in ROW]
                                             + [pa.array(c, pa.string()) for c in cols], [*ROW, *ENTITY])

    schema = "kid string, no_id boolean, th long, kind string, canon string, gender string"
    return landed(rows.select(*ROW, _text(text).alias("text")).mapInArrow(find, schema), "mentions")


def numbered(kind: str, canon: str, gender: str, key: bytes, of: str | None = None) -> str:
    """A surrogate outside the format, for formats with too few values: 128 bits of the key and the entity."""
    name = f"{kind}-{hmac.new(key, repr((kind, canon, gender)).encode(), 'sha256').hexdigest()[:32]}"
    if kind == "email":
        return f"{name}@{of or draw(*part(kind, canon), '', 0, key)}"
    return f"{name}.{canon.rsplit('.', 1)[1]}" if kind == "host" else name


def _rounds(known: DataFrame, key: bytes, bits: int, most: int) -> DataFrame:
    """``known`` (kind, canon, gender, of) with attempt and surrogate: distinct within a kind, none of them known.

    A format may have fewer values than the corpus has entities of it (mail addresses with
    one letter before the sign, say): what still collides after ``most`` draws gets a
    ``numbered`` surrogate, which keeps the kind and distinctness but not the format."""
    cols = [*ENTITY, "of", "attempt"]
    schema = "kind string, canon string, gender string, of string, attempt int, surrogate string"

    def drawn(rows: DataFrame) -> DataFrame:
        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [draw(kind, canon, gender, attempt, key, bits, of) if attempt < most else numbered(kind, canon, gender, key, of)
                       for kind, canon, gender, of, attempt in zip(*[column(batch, c).to_pylist() for c in cols])]
                yield pa.RecordBatch.from_arrays([column(batch, c) for c in cols] + [pa.array(new, pa.string())], [*cols, "surrogate"])
        return rows.select(*cols).mapInArrow(take, schema)

    held = landed(drawn(known.withColumn("attempt", F.lit(0))), "draws")
    real = known.select("kind", F.col("canon").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    for attempt in range(1, most + 1):
        # of equal draws the one drawn first stays, and in a tie the least entity
        best = held.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon", "gender")).alias("best"),
                                                     F.count(F.lit(1)).alias("n"))
        clash = best.join(real, ["kind", "surrogate"], "left").where("n > 1 or real")
        lost = held.join(clash, ["kind", "surrogate"]).where(
            F.col("real").isNotNull() | (F.struct("attempt", "canon", "gender") != F.col("best"))).select(*ENTITY, "of")
        lost = landed(lost, "lost")
        if lost.isEmpty():
            break
        again = drawn(lost.withColumn("attempt", F.lit(attempt)))
        held = landed(held.join(lost, ENTITY, "left_anti").unionByName(again), "draws")
    return held


def redraws(found: DataFrame, key: bytes, bits: int = 128, most: int = 24) -> DataFrame:
    """kind, canon, gender and surrogate of the mentioned entities whose first draw does not stand."""
    mentioned = found.select(*ENTITY).distinct()
    one = mentioned.where("kind = 'name' and gender <> ''").groupBy("kind", "canon").agg(
        F.min("gender").alias("one"), F.max("gender").alias("other")).where("one = other").drop("other")
    part_kind = F.when(F.col("kind") == "email", "host").when(F.col("kind").isin("name", "surname"), "surname")
    part_canon = F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1)).otherwise(F.substring_index("canon", " ", -1))
    known = landed(mentioned.join(one, ["kind", "canon"], "left").select(
        *ENTITY, F.when(F.col("gender") == "", F.coalesce("one", "gender")).otherwise(F.col("gender")).alias("settled"),
        part_kind.alias("part_kind"), F.when(part_kind.isNotNull(), part_canon).alias("part_canon")), "entities")

    parts = known.where("part_kind is not null").select(F.col("part_kind").alias("kind"), F.col("part_canon").alias("canon")).distinct()
    part_draws = _rounds(parts.select("kind", "canon", F.lit("").alias("gender"), F.lit(None).cast("string").alias("of")), key, bits, most)
    moved = landed(part_draws.where("attempt > 0").select(
        F.col("kind").alias("part_kind"), F.col("canon").alias("part_canon"), F.col("surrogate").alias("of")), "parts")

    # only entities whose host or surname was drawn again meet its list
    whole = known.where("kind <> 'surname'").select("kind", "canon", F.col("settled").alias("gender"), "part_kind", "part_canon").distinct()
    part_key = F.xxhash64("part_kind", "part_canon")
    marked = _marked(whole, part_key, moved, part_key, 1 << 16)
    plain = marked.where("not _maybe").withColumn("of", F.lit(None).cast("string"))
    met = marked.where("_maybe").join(moved, ["part_kind", "part_canon"], "left")
    draws = _rounds(plain.select(*ENTITY, "of").unionByName(met.select(*ENTITY, "of")), key, bits, most)

    settled = known.select(*ENTITY, "settled")
    changed = draws.withColumnRenamed("gender", "settled").join(settled, ["kind", "canon", "settled"]).where(
        "attempt > 0 or of is not null or gender <> settled").select(*ENTITY, "surrogate")
    surnames = part_draws.where("attempt > 0").join(known.where("kind = 'surname'").select(*ENTITY), ENTITY, "left_semi")
    return changed.unionByName(surnames.select(*ENTITY, "surrogate"))


def replace_all(docs: DataFrame, key: bytes, *, id_column: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with the new text and the kinds replaced beside it."""
    rows = _rows(docs, id_column, text)
    found = mentions(rows, text)
    again = redraws(found, key, bits)
    lists = landed(found.join(again, ENTITY).groupBy(*ROW).agg(
        F.collect_set(F.struct(*ENTITY, "surrogate")).alias("redrawn")), "redrawn")

    @F.pandas_udf("text string, kinds array<string>")
    def put(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for whole, lists_ in batches:
            new, kinds = [], []
            for t, redrawn in zip(whole, lists_):
                names = {(r["kind"], r["canon"], r["gender"]): r["surrogate"] for r in (() if redrawn is None else redrawn)}
                got, k = replace(t or "", names, key, bits)
                new.append(None if t is None else got)
                kinds.append(k)
            yield pd.DataFrame({"text": new, "kinds": kinds})

    marked = _marked(rows, F.xxhash64(*ROW), lists, F.xxhash64(*ROW), 1 << 16)
    plain = marked.where("not _maybe").select("doc", F.lit(None).cast(lists.schema["redrawn"].dataType).alias("redrawn"))
    met = marked.where("_maybe").join(lists, ROW, "left").select("doc", "redrawn")
    # only texts go to Python; non-deterministic, lest both fields compute it
    new = put.asNondeterministic()(_text(text), F.col("redrawn")).alias("new")
    return plain.unionByName(met).select("doc", new).select("doc", "new.*")
