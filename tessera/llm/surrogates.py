"""PII surrogates: keyed, type-consistent replacements."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

KEY = "surrogate-key-1"
#: Entities whose first surrogate was taken are passed to tasks as one table up to this number, and joined to their documents beyond.
OVERRIDES_ON_DRIVER = 50_000
ROUNDS = 8
#: From this attempt on, a replacement need not have its entity's shape; after so many attempts, there is something wrong.
WIDEN, MOST_ATTEMPTS = 4, 64
#: Entities that one task replaces; they are few bytes each, so their number says more than their size.
ENTITIES_PER_TASK = 5_000

EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_+/=-]{8,})")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?![\w-])")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w.])\+\d{8,15}(?!\w)")
#: Numbers with a country's prefix or a leading zero, in groups of any size; DIGITS in all, and not starting as a date does.
GROUPED = re.compile(r"(?<![\w.:/+-])(?:\+\d{1,3}(?:[ ./-]?\(\d{1,4}\))?|\(0\d{1,4}\)|0\d{1,4})(?:[ ./-]?\(0\))?(?:[ ./-]\d{1,8}){1,6}(?![\w:/-]|[.,]\d)")
DATE = re.compile(r"\d{1,2}[ ./-]\d{1,2}[ ./-](?:19|20)\d\d(?!\d)")
DIGITS = range(8, 16)
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f:]*[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{1,4})?(?![\w:])")
#: Titles and the gender they tell; fixed values.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "n", "Prof": "n", "מר": "m", "גברת": "f", "גב׳": "f", "ד״ר": "n", "السيد": "m", "السيدة": "f", "الدكتور": "n", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
TITLE = re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?[ \u00a0]+")
#: A word of a name and what follows it before the next one; an initial may have a full stop.
PART = re.compile(r"([^\W\d_]+(?:[-'’][^\W\d_]+)*)(?:(?<=\b[^\W\d_])\.)?([ \u00a0]*)")
#: Words that follow a title in scripts without capitals, as a name, at most; a name of Chinese characters stands before its title.
UNCASED_WORDS = 2
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "博士": "n"}
HAN = re.compile(rf"([\u4e00-\u9fff]{{2,3}})(?={'|'.join(HAN_TITLES)})")
PARTICLES = frozenset("von van vom zu zum zur der den de del della di da das do dos du la las le les los y e i bin ibn ben al el af av ten ter".split())
#: Syllables that names are built from, by script, and endings by script and gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо ва ве ви во га го да де ди до за зе ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то".split(),
    "hebrew": "בא בו גי דא דו זי חן טל יע כר לי מא נו סי עד פר צי קר רו שי תם".split(),
    "arabic": "با بو جي دا سا شي عا فا قا كا لي ما نا نو را رو طا هي وا يا".split(),
    "cjk": list("安白柏昌晨达德东方丰光国海浩和恒宏华嘉建江杰金景俊凯康兰乐林龙明宁平青荣瑞山书思松泰天文武祥晓新星雅阳永宇元云泽志中"),
    "greek": "βα βε βι βο γα γε δα δε δι δο ζα ζε θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {
    "latin": {"m": "n", "f": "na", "n": "ris", "s": "rin"},
    "cyrillic": {"m": "н", "f": "на", "n": "рис", "s": "рин"},
    "hebrew": {"m": "ון", "f": "ית", "n": "אל", "s": "ני"},
    "arabic": {"m": "د", "f": "ة", "n": "ن", "s": "ي"},
    "cjk": {"m": "", "f": "", "n": "", "s": ""},
    "greek": {"m": "νος", "f": "να", "n": "ρις", "s": "ριν"},
}
KINDS = ("secret", "email", "iban", "ip", "ssn", "card", "phone", "name")
#: Initials come with names; each letter has another, and they are no entities.
_RANK = {k: i for i, k in enumerate((*KINDS, "initial"))}


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "") if word else ""
    return next((s for s in SYLLABLES if name.startswith(s.upper())), "latin")


def _luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-1]]
    return sum(odd[::2] + [d * 2 - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0


def _is_ipv6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return value.count(":") > 2 or any(map(str.isdigit, value))  # else a::b of a program


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Names after titles: initials, particles (which stay) and all capitalised words, or, of scripts without capitals, UNCASED_WORDS; Chinese ones
    before titles; and every other mention of such a word in the text."""
    hits, known = [], {}
    for title in TITLE.finditer(text):
        words, at = [], title.end()
        while m := PART.match(text, at):
            word = m[1]
            uncased = word[0].upper() == word[0].lower()
            if word in TITLES or not (word[0].isupper() or word in PARTICLES or (uncased and len(words) < UNCASED_WORDS)):
                break
            if word[0].isupper() or uncased:
                words.append((*m.span(1), "initial" if len(word) == 1 else "name", TITLES[title[1]]))
            at = m.end()
            if not m[2]:
                break
        full = [w for w in words if w[2] == "name"]
        if full:  # the last is the surname, alike for all genders
            words = [(a, b, k, "s" if (a, b) == full[-1][:2] else g) for a, b, k, g in words]
            hits += words
            for a, b, k, g in words:
                if k == "name":
                    known.setdefault(text[a:b], g)
    for m in HAN.finditer(text):
        hits.append((*m.span(1), "name", HAN_TITLES[text[m.end() : m.end() + 2]]))
        known.setdefault(m[1], hits[-1][3])
    if known:
        known |= {w.upper(): g for w, g in known.items() if w.upper() not in known}
        taken = {h[0] for h in hits}
        spelled = sorted(known, key=len, reverse=True)
        words, inside = ("|".join(map(re.escape, (w for w in spelled if (script_of(w) == "cjk") == cjk))) or "(?!)" for cjk in (False, True))
        mention = re.compile(rf"(?<![^\W_])(?:{words})(?![^\W_])|(?:{inside})")  # Chinese has no spaces
        hits += [(*m.span(), "name", known[m[0]]) for m in mention.finditer(text) if m.start() not in taken]
    return hits


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of each entity, left to right and apart; where two overlap, the kind first in KINDS wins."""
    hits = []
    digits = _ANY_DIGIT.search(text) is not None
    if "=" in text or ":" in text:
        hits += [(*m.span(1), "secret", "") for m in SECRET.finditer(text)]
    if "@" in text:
        hits += [(*m.span(), "email", "") for m in EMAIL.finditer(text)]
    if digits:
        for kind, pattern in (("iban", IBAN), ("ip", IP), ("ssn", SSN), ("card", CARD), ("phone", PHONE)):
            hits += [(*m.span(), kind, "") for m in pattern.finditer(text)]
        hits += [(*m.span(), "phone", "") for m in GROUPED.finditer(text) if sum(map(str.isdigit, m[0])) in DIGITS and not DATE.match(m[0])]
    if text.count(":") > 1:
        hits += [(*m.span(), "ip", "") for m in IPV6.finditer(text) if _is_ipv6(m[0])]
    if _ANY_TITLE.search(text) or HAN.search(text):
        hits += names(text)
    out, end = [], set()
    for h in sorted(hits, key=lambda h: _RANK[h[2]]):
        span = range(h[0], h[1])
        if end.isdisjoint(span):
            end.update(span)
            out.append(h)
    return sorted(out)


_ANY_DIGIT = re.compile(r"\d")
_ANY_TITLE = re.compile(rf"\b(?:{'|'.join(TITLES)})\b")


def canonical(kind: str, value: str, gender: str) -> str:
    """What mentions of one entity have in common: case, spacing and punctuation of numbers do not count. Of a name: script, gender, word."""
    if kind == "name":
        return f"{script_of(value)}:{gender}:{value.lower()}"
    if kind in ("card", "phone", "ssn"):
        return "".join(c for c in value if c.isdigit() or c == "+")
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip" and ":" in value:
        return str(ipaddress.IPv6Address(value))
    return value if kind == "secret" else value.lower()


def _number(key: str, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key.encode()[:64], digest_size=8).digest(), "little")


def permute(value: str, key: str, fixed: set[int] = frozenset(), hexadecimal: bool = False) -> str:
    """A keyed bijection on strings of one shape: each letter and digit becomes one of its own class, everything else stays.

    A Feistel network whose two halves are the movable characters, each a number in the radix of its class.
    """
    classes = []
    for i, c in enumerate(value):
        alphabet = next((a for a in (_HEX if hexadecimal else _ALPHABETS) if c in a), None)
        if alphabet and i not in fixed:
            classes.append((i, alphabet))
    if not classes:
        return value
    digits = [a.index(value[i]) for i, a in classes]
    half = len(digits) // 2
    shape = "".join(c if i in fixed or not c.isalnum() else str(len(next((a for a in _ALPHABETS if c in a), ""))) for i, c in enumerate(value))
    for r in range(ROUNDS):
        mine, other = (range(half), digits[half:]) if r % 2 else (range(half, len(digits)), digits[:half])
        for j in mine:
            digits[j] = (digits[j] + _number(key, shape, r, j, *other)) % len(classes[j][1])
    out = list(value)
    for (i, a), d in zip(classes, digits):
        out[i] = a[d]
    return "".join(out)


_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_INITIALS = (_ALPHABETS[1], "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def surrogate(kind: str, entity: str, key: str, attempt: int = 0) -> str:
    """The replacement of a canonical entity, itself canonical; another attempt gives another one."""
    key = f"{key}/{kind}/{attempt}"
    if attempt >= WIDEN and kind != "name":
        return _other_shape(kind, entity, key, attempt)
    if kind == "name":
        script, gender, word = entity.split(":", 2)
        n, syllables, out = _number(key, script, word), SYLLABLES[script], ""
        if script == "cjk":  # a character for each, and one more for every few attempts
            n = _number(key, script, word, "cjk")
            for i in range(len(word) + attempt // 3):
                out += syllables[_number(key, n, i) % len(syllables)]
            return f"{script}:{gender}:{out}"
        for _ in range(2 + attempt // 3 + len(word) // 5):
            n, k = divmod(n, len(syllables))
            out += syllables[k]
        return f"{script}:{gender}:{out}{ENDINGS[script][gender]}"
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        stays = 2 if labels[-2:-1] == ["example"] else 1
        kept = sum(map(len, labels[-stays:])) + stays - 1
        return permute(entity, key, set(range(len(entity) - kept, len(entity))))
    if kind == "ip" and ":" in entity:
        left, right = divmod(int(ipaddress.IPv6Address(entity)), 1 << 64)
        for r in range(ROUNDS):
            left, right = right, left ^ _number(key, r, right)
        return str(ipaddress.IPv6Address(left << 64 | right))
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        left, right = n >> 16, n & 0xFFFF
        for r in range(ROUNDS):
            left, right = right, left ^ (_number(key, r, right) & 0xFFFF)
        return ".".join(map(str, ((left << 16) | right).to_bytes(4, "big")))
    if kind == "card":
        if _luhn(entity):
            body = permute(entity[:-1], key, {0})
            return next(body + c for c in "0123456789" if _luhn(body + c))
        return permute(entity, key, {0})
    if kind == "phone":
        return permute(entity, key, {0, 1} if entity.startswith("+") else {0} if entity.startswith("0") else set())
    if kind == "iban":
        country, body = entity[:2], entity[4:]
        if entity[2:4] == _iban_check(country, body):  # a valid number stays one
            body = permute(entity, key, {0, 1, 2, 3})[4:]
            return country + _iban_check(country, body) + body
        return permute(entity, key, {0, 1})
    return permute(entity, key, hexadecimal=kind == "secret" and bool(re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", entity)))


def _other_shape(kind: str, entity: str, key: str, attempt: int) -> str:
    """For shapes with too few values, or none to choose from: drawn anew, longer with every few attempts, in the kind's general form."""
    n, more = _number(key, entity), attempt - WIDEN
    if kind == "ip":
        return str(ipaddress.IPv6Address(n << 64 | _number(key, entity, 2))) if ":" in entity else ".".join(map(str, n.to_bytes(8, "big")[:4]))
    alphabet = _ALPHABETS[2] if kind in ("card", "phone", "ssn") else _ALPHABETS[0] + _ALPHABETS[2]
    size = max(8, len(entity)) + more // 4
    out = ""
    while len(out) < size:
        n, k = divmod(n, len(alphabet)) if n else divmod(_number(key, entity, len(out) + 3), len(alphabet))
        out += alphabet[k]
    if kind == "email":
        return f"{out}@example.org"
    return "+" + out if kind == "phone" and entity.startswith("+") else entity[:2] + out.upper() if kind == "iban" else out


def _iban_check(country: str, body: str) -> str:
    """The two digits that make country, digits and body a valid account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{body}{country}00')) % 97:02d}"


def dress(kind: str, replacement: str, value: str) -> str:
    """The canonical replacement in the format of one mention: its case, spacing and punctuation."""
    if kind == "name":
        word = replacement.split(":", 2)[2]
        return word.upper() if value.isupper() and len(value) > 1 else word[:1].upper() + word[1:]
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(replacement.replace("+", ""))
        return "".join(next(chars, "") if c.isalnum() else c for c in value) + "".join(chars)
    if kind == "email" and value != value.lower() and len(value) == len(replacement):
        return "".join(r.upper() if v.isupper() else r for r, v in zip(replacement, value))
    return replacement


def initial(letter: str, key: str) -> str:
    """Another capital of the letter's script, the same for all its mentions."""
    alphabet = next((a for a in _INITIALS if letter in a), _INITIALS[0])
    at = alphabet.index(letter) if letter in alphabet else _number(key, "initial", letter)
    return alphabet[(at + 1 + _number(key, "initial") % (len(alphabet) - 1)) % len(alphabet)]


def rewrite(text: str, key: str, overrides: dict[tuple[str, str], int]) -> tuple[str, dict[str, int]]:
    out, at, counts = [], 0, {}
    for a, b, kind, gender in find(text):
        if kind == "initial":
            out += [text[at:a], initial(text[a:b], key)]
            at = b
            continue
        entity = canonical(kind, text[a:b], gender)
        out += [text[at:a], dress(kind, surrogate(kind, entity, key, overrides.get((kind, entity), 0)), text[a:b])]
        at = b
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[at:]]) if out else text, counts


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, entity): each document's distinct entities in canonical form."""

    def extract(batches):
        for b in batches:
            rows = [(i, k, e) for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for k, e in sorted({(k, canonical(k, t[a:z], g)) for a, z, k, g in find(t) if k != "initial"})]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "kind", "entity"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(extract, "doc_id long, kind string, entity string")


def resolve(known: DataFrame, key: str = KEY) -> DataFrame:
    """known: distinct (kind, entity). Returns those that need another attempt than the first: (kind, entity, attempt).

    A surrogate is refused if it is an entity of the corpus itself or belongs to an entity that comes first (by attempts, then name). Refused
    ones try again until none is, from attempt WIDEN on in a wider shape, so that even a shape with one value ends; so different entities keep different surrogates, and one entity has one everywhere.
    """

    @F.pandas_udf("string")
    def replace(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, key, int(a)) for k, e, a in zip(kind, entity, attempt)])

    known = materialise(known)
    parts = max(1, -(-known.count() // ENTITIES_PER_TASK))
    spread = lambda df: df.repartition(parts, "kind", "entity").withColumn("replacement", replace("kind", "entity", "attempt"))
    taken = materialise(spread(known.withColumn("attempt", F.lit(0))))
    for _ in range(MOST_ATTEMPTS):
        real = known.select("kind", F.col("entity").alias("replacement"), F.lit(True).alias("real"))
        first = taken.groupBy("kind", "replacement").agg(F.min(F.struct("attempt", "entity")).alias("first"))
        judged = taken.join(first, ["kind", "replacement"]).join(real, ["kind", "replacement"], "left")
        refused = F.coalesce("real", F.lit(False)) | (F.col("first.entity") != F.col("entity"))
        judged = materialise(judged.select("kind", "entity", "attempt", "replacement", refused.alias("refused")))
        if judged.filter("refused").isEmpty():
            return judged.filter("attempt > 0").select("kind", "entity", "attempt")
        again = judged.filter("refused").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        taken = materialise(judged.filter("not refused").drop("refused").unionByName(spread(again)))
    raise RuntimeError(f"surrogates still collide after {MOST_ATTEMPTS} attempts")


def with_surrogates(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text with every detected entity replaced, n_entities and kinds (count of each kind as "kind=n,...").

    Kinds: secrets after a keyword, e-mail addresses, IBANs, IP addresses, social security, card and phone numbers, and names after a
    title with all their other mentions in the same document. Numbers and addresses go through keyed bijections on their shape (cards keep their check digit valid, phones the country's
    first digit); given names keep script and the title's gender, surnames
    their script. The same entity has the same surrogate in every document.

    Null and empty texts become empty; texts without entities come back unchanged. Repeated rows, null ids and ties are rows like others;
    other columns are ignored; an empty table gives no rows.
    """
    found = materialise(entities(docs, id_col, text_col))
    overrides = materialise(resolve(found.select("kind", "entity").distinct(), key))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    common: dict[tuple[str, str], int] = {}
    if overrides.count() <= OVERRIDES_ON_DRIVER:
        common = {(r["kind"], r["entity"]): r["attempt"] for r in overrides.collect()}
        rows = rows.withColumn("own", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        own = found.join(overrides, ["kind", "entity"]).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("own"))
        rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")

    def replace(batches):
        for b in batches:
            done = []
            for t, own in zip(b["text"].to_pylist(), b["own"].to_pylist()):
                mine = {(o["kind"], o["entity"]): o["attempt"] for o in own} if own else common
                done.append(rewrite(t, key, mine))
            texts = pa.array([t for t, _ in done], pa.string())
            n = pa.array([sum(c.values()) for _, c in done], pa.int64())
            kinds = pa.array([",".join(f"{k}={c[k]}" for k in KINDS if k in c) for _, c in done], pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], texts, n, kinds], names=["doc_id", "text", "n_entities", "kinds"])

    return rows.mapInArrow(replace, "doc_id long, text string, n_entities long, kinds string")
