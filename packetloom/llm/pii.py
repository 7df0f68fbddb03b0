"""Personal data replaced by keyed surrogates of the same kind.

Entities are found by patterns and replaced by values drawn from HMAC-SHA256 of the entity under a secret
key, so that one entity has one surrogate in every document (coreference) and different entities have
different ones (distinctness). Surrogates keep kind and format: a phone number keeps its separators and
country code, a card number its issuer digit and check digit, an address its private or public range, a
secret its alphabet, a name its gender, script and letter case.

Distinctness is checked over the whole table: where the surrogates of two entities coincide, or one is an
entity of the table itself, all but the first take the next attempt, until none is left. Where a form has few
values, as 192.168.x.x, attempts from ``WIDER`` on take a wider form of the kind, and from ``TOKENS`` on a
token of letters that names the kind, so that every entity gets a surrogate however full a space is.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom.llm.common import blocks, map_blocks, materialize

# Titles that announce a name, by the gender they tell.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor"),
}
# Given names by script and gender, for surrogates and to tell the gender of a name without title.
GIVEN = {
    "latin": {
        "m": "Adam Albert Alexander Anton Ben Carlos Daniel David Emil Felix Frank George Henry Hugo Ivan Jack James John Juan Karl Leo Louis Lucas Marc Martin Max Michael Oliver Oscar Paul Peter Pierre Robert Simon Thomas Victor Walter William".split(),
        "f": "Alice Anna Barbara Carmen Carla Clara Diana Elena Emma Eva Flora Grace Hannah Helen Ida Irene Jane Julia Laura Lucia Marie Maria Marta Mary Mia Nina Nora Olivia Paula Rosa Ruth Sara Sophie Susan Teresa Ursula Vera Zoe".split(),
    },
    "cyrillic": {"m": "Алексей Борис Виктор Дмитрий Иван Максим Николай Олег Павел Сергей".split(), "f": "Анна Вера Галина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split()},
    "greek": {"m": "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος".split(), "f": "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split()},
}
# Syllables that surnames are made of.
SYLLABLES = {
    "latin": "ba bel bo bran cal cor da del dor el fa fen gar gil ha hol jan ka kel la len lin lo mar mel mor na nel nor ol pa per ra rin ro sal sen sol ta tal tor va ven vi wel win zan".split(),
    "cyrillic": "ба вал вин го дар до за кар кол ла лев мар мел на ор пет ра род са сел то фед ча".split(),
    "greek": "αν βα γα δη κα κο λα μα νι πα ρο σα στα τσα φω χα".split(),
}
ENDINGS = {"latin": ("er", "son", "man", "dal", "ton", "ard"), "cyrillic": ("ов", "ин", "ко"), "greek": ("ίδης", "άκης", "όπουλος")}

def _letters(last: int, *categories: str) -> str:
    """Ranges, for a class of ``re``, of the characters in Unicode categories, up to the character ``last``."""
    out: list[list[int]] = []
    for c in range(last + 1):
        if unicodedata.category(chr(c)) in categories:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" if a < b else chr(a) for a, b in out)


#: The last character of texts without rare scripts, whose short classes are quick; letters with case lie in the first two planes.
_LAST = {False: 0xFFFF, True: 0x1FFFF}
_RARE = re.compile("[\U00010000-\U0010ffff]")
_CASES = {rare: (_letters(last, "Lu", "Lt"), _letters(last, "Ll"), _letters(last, "Mn", "Mc")) for rare, last in _LAST.items()}


def _name_pattern(rare: bool) -> str:
    """Words of a capital, a small letter and all letters with case that follow, so that a name ends where its word does."""
    upper, lower, mark = _CASES[rare]
    word = f"[{upper}][{mark}]*[{lower}][{upper}{lower}{mark}]*"
    return f"{word}(?:['’-]{word})?"


_NAME = "<name>"
_GENDER = {n: g for by in GIVEN.values() for g, names in by.items() for n in names}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}

#: Kind and pattern, the first that matches at a place counts. A group called ``v`` is the entity, else all of it; ``_NAME`` stands for a name.
PATTERNS = (
    ("email", r"[A-Za-z0-9ß-öø-ÿ_+-]+(?:\.[A-Za-z0-9ß-öø-ÿ_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"),
    ("secret", r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)(?P<v_secret>(?=[_/+.-]*[A-Za-z0-9])[A-Za-z0-9_/+.-]{8,})"),
    ("secret", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{40}|[0-9a-f]{64})\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d+.-])(?:\d{4}[ -]?){3}\d{4}(?![\d-]|\.\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])"),
    ("name", rf"\b(?:{'|'.join(sorted(map(re.escape, _TITLE), key=len, reverse=True))})\.?[ \t]+(?P<v_name>{_NAME}(?:[ \t]+{_NAME})?)"),
    ("name", rf"\b(?:{'|'.join(_GENDER)})[ \t]+{_NAME}"),
)
_FIND = {
    (names, rare): re.compile("|".join(f"(?P<k{i}>{p.replace(_NAME, _name_pattern(rare))})" for i, (k, p) in enumerate(PATTERNS) if names or k != "name"))
    for names in (False, True)
    for rare in (False, True)
}
_KEYWORDS = ("token", "secret", "passw", "key")
_DIGIT = re.compile(r"\d")  # of any script, as in the patterns
_KEY_STARTS = ("AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_HEX_LETTERS = re.compile("[a-f]{40}")
_TWO_NAMES = {r: re.compile(f"[{u}][{l}{m}'’-]*[ \\t]+[{u}][{m}]*[{l}]") for r, (u, l, m) in _CASES.items()}
_DOTTED = tuple(f"{t}. " for t in _TITLE) + tuple(f"{t}.\t" for t in _TITLE)


def _rare(text: str) -> bool:
    return not text.isascii() and _RARE.search(text) is not None


def may_hold(text: str) -> tuple[bool, bool]:
    """Whether the text has what the patterns need: a digit, an @, a key word in any case or the start of a key without digits; and, for names, two capitalised words in a row or a title with a dot.

    Every text with an entity passes.
    """
    other = any(c in text for c in "@0123456789") or any(w in text for w in _KEY_STARTS)
    if not other:
        folded = text.casefold()  # as (?i) does, this takes ſ for s and the Kelvin sign for k
        other = any(w in folded for w in _KEYWORDS) or _HEX_LETTERS.search(text) is not None or (not text.isascii() and _DIGIT.search(text) is not None)
    return other, any(t in text for t in _DOTTED) or _TWO_NAMES[_rare(text)].search(text) is not None


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) from left to right. The kind of a name tells script and gender, as ``name:latin:f``."""
    out = []
    other, names = may_hold(text)
    if not (other or names):
        return out
    for m in _FIND[names, _rare(text)].finditer(text):
        groups = m.groupdict()
        i = next(i for i in range(len(PATTERNS)) if groups.get(f"k{i}") is not None)
        kind, group = PATTERNS[i][0], next((g for g in ("v_secret", "v_name") if groups.get(g) is not None), 0)
        start, end = m.span(group)
        found = text[start:end]
        if kind == "name":
            title = "n" if group == 0 else _TITLE[re.match(r"[^\s.]+", m.group())[0]]
            kind = f"name:{script(found)}:{title if title != 'n' else _GENDER.get(found.split()[0], 'n')}"
        out.append((start, end, kind, found))
    return out


def script(text: str) -> str:
    return next((s for c in text for s, a, b in (("cyrillic", "Ѐ", "ԯ"), ("greek", "Ͱ", "Ͽ"), ("greek", "ἀ", "῿")) if a <= c <= b), "latin")


#: Attempts from which on a form with a bounded number of values is widened, and those that take tokens.
WIDER, TOKENS = 8, 16
_PHONE = re.compile(next(p for k, p in PATTERNS if k == "phone"))


class _Stream:
    """Numbers drawn one after another from the HMAC of kind, entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int) -> None:
        self.key, self.seed, self.n, self.pool = key, f"{kind}\0{entity}\0{attempt}".encode(), 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n * 2**64:
            self.pool = int.from_bytes(hmac.new(self.key, self.seed + b"\0%d" % self.n, hashlib.sha256).digest())
            self.left, self.n = 2**256, self.n + 1
        self.pool, value = divmod(self.pool, n)
        self.left //= n
        return value

    def of(self, items):
        return items[self.below(len(items))]


def _same_letters(text: str, draw: _Stream) -> str:
    """Each digit by a digit, each letter by one of its case; hex stays hex; the rest stays."""
    hexes = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    low, high = ("abcdef", "ABCDEF") if hexes else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return "".join(draw.of("0123456789") if c.isdigit() else draw.of(low) if c.islower() else draw.of(high) if c.isupper() else c for c in text)


def _digits(text: str, draw: _Stream, fixed: int) -> str:
    """New digits after the first ``fixed`` ones; a first digit that isn't 0 stays so; separators stay."""
    out, seen = [], 0
    for c in text:
        if c.isdigit():
            seen += 1
            c = c if seen <= fixed else str(1 + draw.below(9)) if seen == 1 and c != "0" else draw.of("0123456789")
        out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _card(text: str, draw: _Stream) -> str:
    valid = luhn(re.sub(r"\D", "", text))
    made = _digits(text, draw, 1)
    last = max(i for i, c in enumerate(made) if c.isdigit())
    fits = [d for d in "0123456789" if luhn(re.sub(r"\D", "", made[:last] + d + made[last + 1 :])) == valid]
    return made[:last] + draw.of(fits) + made[last + 1 :]


def _iban(text: str, draw: _Stream) -> str:
    """Country kept, account anew, check digits to match."""
    body = _same_letters(text[4:], draw)
    plain = re.sub(r"\s", "", body) + text[:2] + "00"
    check = 98 - int("".join(str(int(c, 36)) for c in plain)) % 97
    return f"{text[:2]}{check:02d}{body}"


def _ip(text: str, draw: _Stream, attempt: int) -> str:
    """The same range; a small private range widens to 10.x.x.x."""
    a, b, _, _ = map(int, text.split("."))
    if attempt >= WIDER and (a == 127 or (a, b) in ((192, 168), (169, 254)) or (a == 172 and 16 <= b < 32)):
        a = 10
    if a == 10 or a == 127:
        head = [a, draw.below(256)]
    elif (a, b) in ((192, 168), (169, 254)):
        head = [a, b]
    elif a == 172 and 16 <= b < 32:
        head = [a, 16 + draw.below(16)]
    else:
        first = draw.of([x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)])
        head = [first, draw.below(256)]
    return ".".join(map(str, [*head, draw.below(256), 1 + draw.below(254)]))


def _phone(text: str, draw: _Stream, attempt: int) -> str:
    """Country code kept; widens by digits at the end where the form allows it."""
    fixed = len(re.match(r"\+?(\d{1,3}(?=\D))?", text)[1] or "") if text.startswith("+") else 0
    longer = text + "0" * max(0, attempt - WIDER + 1)
    return _digits(longer if _PHONE.fullmatch(longer) else text, draw, fixed)


def _secret(text: str, draw: _Stream, attempt: int) -> str:
    """The same alphabet; widens by characters of the kinds it has."""
    kinds = [c for c in text if c.isalnum()]
    return _same_letters(text + "".join(draw.of(kinds) for _ in range(max(0, attempt - WIDER + 1))), draw)


def _token(kind: str, draw: _Stream) -> str:
    """The kind and letters that no pattern matches, for spaces that are full."""
    return f"{kind}-" + "".join(draw.of("ghijklmnopqrstuvwxyz") for _ in range(24))


def _email(text: str, draw: _Stream, attempt: int) -> str:
    """A new local part of the same form at a reserved domain with the same ending."""
    local, domain = text.rsplit("@", 1)
    made = "".join(draw.of("abcdefghijklmnopqrstuvwxyz") if c.isalpha() and c.islower() else draw.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isalpha() else draw.of("0123456789") if c.isdigit() else c for c in local)
    made += "".join(draw.of("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(max(0, 8 - len(local)) + attempt))
    return f"{made}@mail{draw.below(1000)}.example.{domain.rsplit('.', 1)[1]}"


def _name(text: str, kind: str, draw: _Stream, attempt: int) -> str:
    _, letters, gender = kind.split(":")
    given = GIVEN[letters]["mf"[draw.below(2)] if gender == "n" else gender]
    surname = lambda: "".join(draw.of(SYLLABLES[letters]) for _ in range(3 + attempt)).capitalize() + draw.of(ENDINGS[letters])
    words = text.split()
    first = draw.of(given) if len(words) > 1 or (words[0] in _GENDER and attempt < WIDER) else surname()
    return " ".join([first, *(surname() for _ in words[1:])])


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The replacement of an entity; never the entity itself."""
    for again in range(1000):
        draw = _Stream(key, kind, entity, attempt * 1000 + again)
        if attempt >= TOKENS and kind in ("ipv4", "card", "iban", "phone", "ssn"):
            return _token(kind, draw)
        if kind == "email":
            made = _email(entity, draw, attempt)
        elif kind == "ipv4":
            made = _ip(entity, draw, attempt)
        elif kind == "card":
            made = _card(entity, draw)
        elif kind == "iban":
            made = _iban(entity, draw)
        elif kind == "phone":
            made = _phone(entity, draw, attempt)
        elif kind == "ssn":
            made = _digits(entity, draw, 0)
        elif kind.startswith("name"):
            made = _name(entity, kind, draw, attempt)
        else:
            made = _secret(entity, draw, attempt)
        if made != entity:
            return made
    return _token(kind.split(":")[0], draw)


def _drawn(found: DataFrame, key: bytes) -> DataFrame:
    """``made`` for ``kind``, ``entity`` and ``attempt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, *x) for x in zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)]
            yield batch.append_column("made", pa.array(made, pa.string()))

    return found.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, made string")


def later_attempts(found: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``entity``, ``attempt`` of the entities whose first surrogate is taken.

    A round draws, groups by surrogate and advances all but the least entity of a group, and every one
    whose surrogate is an entity of the table. Only entities that collide go into the next round, checked
    against the surrogates of all others. Every kind ends in values whose number grows or is beyond any
    table's, so rounds end: a full space needs a few more than ``TOKENS``.
    """
    state = materialize(_drawn(found.withColumn("attempt", F.lit(0)), key), "pii-attempt")
    real = found.select(F.col("entity").alias("made")).distinct()
    while True:
        first = state.groupBy("made").agg(F.min(F.struct("attempt", "kind", "entity")).alias("owner"), F.count("*").alias("n"))
        taken = first.join(real.withColumn("real", F.lit(True)), "made", "left").where("n > 1 or real")
        hit = state.join(taken, "made").where(F.col("real") | (F.struct("attempt", "kind", "entity") != F.col("owner"))).select("kind", "entity")
        hit = materialize(hit, "pii-hits")
        if hit.isEmpty():
            return state.where("attempt > 0").select("kind", "entity", "attempt")
        again = state.join(hit.withColumn("hit", F.lit(True)), ["kind", "entity"], "left")
        state = materialize(_drawn(again.where("hit").withColumn("attempt", F.col("attempt") + 1), key).union(again.where("hit is null").select("kind", "entity", "attempt", "made")), "pii-attempt")


def found_entities(docs: DataFrame, text: str) -> DataFrame:
    """Distinct ``kind``, ``entity`` of the table; repeated ones are dropped in each block of rows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = sorted({(k, e) for x in block.column("text").to_pylist() if x for _, _, k, e in entities(x)})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], ["kind", "entity"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, entity string").distinct()


def replaced(text: str, key: bytes, attempts: dict) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the kinds with their places in it."""
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, found in entities(text):
        made = surrogate(key, kind, found, attempts.get((kind, found), 0))
        out += [text[at:start], made]
        size += start - at
        spans.append((size, size + len(made), kind))
        size += len(made)
        at = end
    return "".join([*out, text[at:]]) if out else text, spans


#: Attempts beyond the first that may be sent to all tasks; more are joined by entity.
FEW_ATTEMPTS = 100_000


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str | None = None) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; all other columns and rows stay as they are.

    ``spans`` names a column to add: (start, end, kind) of each surrogate in the new text. Null texts stay
    null; texts without entities stay equal; repeated rows are replaced alike; an empty table stays empty.
    Only entities whose first surrogate is taken need a look-up. A few are broadcast; more reach each row by
    a join on the entities it holds.
    """
    later = materialize(later_attempts(materialize(found_entities(docs, text), "pii-found"), key), "pii-later")
    n = later.count()
    row, extra = "__pii_row", "__pii_attempts"
    if n <= FEW_ATTEMPTS:
        known = {(r.kind, r.entity): r.attempt for r in later.collect()}  # at most FEW_ATTEMPTS
        rows = docs
    else:
        known = {}
        rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pii-rows")
        held = map_blocks(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), "text", "row long, held array<struct<kind:string,entity:string>>", lambda b: {"row": b.column("row"), "held": [[{"kind": k, "entity": e} for k, e in sorted({(k, e) for _, _, k, e in entities(x or "")})] for x in b.column("text").to_pylist()]})
        held = held.select("row", F.explode("held").alias("h")).select("row", "h.*").join(later, ["kind", "entity"])
        held = held.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(extra))
        rows = rows.join(held, row, "left").drop(row)
    schema = docs.schema if spans is None else docs.withColumn(spans, F.lit(None).cast("array<struct<start:int,end:int,kind:string>>")).schema
    arrow = to_arrow_schema(schema)
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch], text):
                own = [{(a["kind"], a["entity"]): a["attempt"] for a in x or ()} for x in block.column(extra).to_pylist()] if extra in block.schema.names else [known] * len(block)
                made = [(None, []) if x is None else replaced(x, key, a) for x, a in zip(block.column(at).to_pylist(), own, strict=True)]
                columns = [pa.array([m for m, _ in made], arrow.field(i).type) if i == at else block.column(i) for i in range(len(names))]
                if spans is not None:
                    columns.append(pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in made], arrow.field(len(names)).type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)
