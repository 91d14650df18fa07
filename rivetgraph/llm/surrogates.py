"""Personal data: detected entities get keyed, type-consistent surrogates.

Kinds: e-mail, card number (Luhn), phone, social security number, IPv4 address, IBAN, and
names after a title, which tells their gender. A surrogate depends on the key, the kind and
the entity's plain form only, so one entity has one surrogate in every document.

* Digits go through a keyed Feistel permutation of numbers of their own length: the format
  stays, and different entities of a format stay different. Country prefixes stay, cards get
  their check digit anew, addresses come from the private range.
* Letters of e-mail local parts and names are drawn from the entity's keyed hash, in the
  entity's script, length class and case; names end as the title's gender has it.

Collisions are checked over all distinct entities, found by grouped aggregation: where two
share a surrogate, or a surrogate is an entity of the corpus, all but the smallest are drawn
again, until none is left; what was drawn again is joined to the documents that hold it.

Defined cases: null and empty texts stay as they are; overlapping matches go to the leftmost,
then the longest; repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib
import hmac
import re

from pyspark.sql import DataFrame, functions as F

from rivetgraph.llm.common import mapped
from rivetgraph.session import cut, cut_counted

KEY = b"surrogate key of this corpus"
MAX_DRAWS = 20

# fixed values: titles by gender, and what a card or phone looks like
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Srta")
MALE = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "M")
KINDS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b")),
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{2,4}[ .-]?\d{2,4}(?:[ .-]?\d{2,4})?(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")),
    ("name", re.compile(
        r"\b(" + "|".join(FEMALE + MALE) + r")\.?[ ]((?:[^\W\d_a-z][^\W\d_]+)(?:[ -][^\W\d_a-z][^\W\d_]+){0,2})"
    )),
)
_ORDER = ("email", "iban", "ssn", "card", "ip", "phone", "name")


def _hash(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permuted(digits: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of the numbers of this length: eight Feistel rounds over its halves."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + _hash(key, tweak) % 10) % 10) if digits else digits
    a, b = digits[: n // 2], digits[n // 2 :]
    for i in range(8):
        a, b = b, str((int(a) + _hash(key, tweak, n, i, b)) % 10 ** len(a)).zfill(len(a))
    return a + b


def luhn_digit(body: str) -> str:
    total = 0
    for i, d in enumerate(map(int, reversed(body))):
        total += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


_CONSONANTS, _VOWELS = "bcdfghjklmnprstvz", "aeiou"


def _letters(h: int, n: int) -> str:
    out = []
    for i in range(n):
        pool = _VOWELS if i % 2 else _CONSONANTS
        h, r = divmod(h, len(pool))
        out.append(pool[r])
    return "".join(out)


def _script_word(word: str, h: int, gender: str) -> str:
    """A name of the word's script, length and case."""
    first = ord(word[0])
    n = max(4, len(word))
    if first < 0x250:
        made = _letters(h, n)
        if gender:
            made = made[:-1] + ("a" if gender == "f" else "o")
    else:
        base = 0x400 if 0x400 <= first < 0x530 else 0x370 if 0x370 <= first < 0x400 else first - first % 0x80
        pool = [chr(c) for c in range(base, base + 0x80) if chr(c).isalpha() and chr(c) == chr(c).lower()] or list(_VOWELS)
        made = ""
        for _ in range(n):
            h, r = divmod(h, len(pool))
            made += pool[r]
    return made.upper() if word.isupper() else made[0].upper() + made[1:]


def surrogate(kind: str, shown: str, key: bytes = KEY, draw: int = 0) -> str:
    """The replacement of an entity as it is written."""
    tweak = f"{kind}:{draw}"
    if kind == "email":
        local, _, _ = shown.partition("@")
        h = _hash(key, tweak, shown.lower())
        parts = [_letters(h >> (32 * i), max(5, len(p))) for i, p in enumerate(re.split(r"[._%+-]", local)[:3])]
        return f"{'.'.join(parts)}{h % 9973}@{_letters(h >> 128, 8)}.example"
    digits = re.sub(r"\D", "", shown)
    if kind == "card":
        body = permuted(digits[1:-1], key, tweak + digits[0])
        return _refill(shown, digits[0] + body + luhn_digit(digits[0] + body))
    if kind == "phone":
        m = re.match(r"\+\d{1,3}(?=\D)", shown)
        head = m.group() if m else ""
        return head + _refill(shown[len(head) :], permuted(re.sub(r"\D", "", shown[len(head) :]), key, tweak + head))
    if kind == "ssn":
        return "9" + _refill(shown[1:], permuted(digits, key, tweak)[1:])
    if kind == "ip":
        a = permuted("".join(p.zfill(3) for p in shown.split(".")), key, tweak)
        v = int(a) % (1 << 24)
        return f"10.{v >> 16}.{v >> 8 & 255}.{v & 255}"
    if kind == "iban":
        h = _hash(key, tweak, shown)
        out = shown[:2]
        for c in shown[2:]:
            h, r = divmod(h, 260)
            out += chr(65 + r % 26) if c.isalpha() else str(r % 10)
        return out
    title, _, rest = shown.partition(" ")
    plain = title.rstrip(".")
    gender = "f" if plain in FEMALE else "m"
    words = re.split(r"([ -])", rest)
    made = [
        w if w in " -" else _script_word(w, _hash(key, tweak, i, w.lower() if i else rest.lower()), gender if i == 0 and len(words) > 1 else "")
        for i, w in enumerate(words)
    ]
    return f"{title} {''.join(made)}"


def detected(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, text) of the entities, leftmost first, without overlap."""
    if not text:
        return []
    found = []
    has_digit = any(map(text.__contains__, "0123456789"))
    for kind, rule in KINDS:
        if kind == "email" and "@" not in text or kind not in ("email", "name") and not has_digit:
            continue
        for m in rule.finditer(text):
            shown = m.group()
            digits = re.sub(r"\D", "", shown)
            if kind == "card" and luhn_digit(digits[:-1]) != digits[-1] and not _card_like(digits):
                continue
            if kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            if kind == "ip" and any(int(p) > 255 for p in shown.split(".")):
                continue
            found.append((m.start(), m.end(), kind, shown))
    found.sort(key=lambda f: (f[0], -f[1], _ORDER.index(f[2])))
    out, at = [], 0
    for f in found:
        if f[0] >= at:
            out.append(f)
            at = f[1]
    return out


def _card_like(digits: str) -> bool:
    """Sixteen digits that start as cards do are treated as one, mistyped or not."""
    return len(digits) == 16 and digits[0] in "3456"


def plain_form(kind: str, shown: str) -> str:
    return shown.lower() if kind == "email" else re.sub(r"\D", "", shown) if kind not in ("iban", "name") else shown


def drawn_again(docs: DataFrame, key: bytes = KEY) -> DataFrame | None:
    """(kind, shown, draw) of the entities whose first surrogate collides; None if there are none."""
    def listed(c: dict) -> dict:
        rows = [(k, s) for t in c["text"] for _, _, k, s in detected(t)]
        return {"kind": [k for k, _ in rows], "shown": [s for _, s in rows]}

    def with_surrogate(rows: DataFrame) -> DataFrame:
        def made(c: dict) -> dict:
            out = [surrogate(k, s, key, d) for k, s, d in zip(c["kind"], c["shown"], c["draw"])]
            forms = [plain_form(k, x) for k, x in zip(c["kind"], out)]
            return {n: c[n] for n in ("kind", "shown", "draw")} | {
                "plain": [plain_form(k, s) for k, s in zip(c["kind"], c["shown"])], "made": forms
            }

        return mapped(rows.select("kind", "shown", "draw"), made, "kind string, shown string, draw int, plain string, made string")

    entities = mapped(docs.select("text"), listed, "kind string, shown string").distinct()
    now, n = cut_counted(with_surrogate(entities.withColumn("draw", F.lit(0))))
    if not n:
        return None
    for _ in range(MAX_DRAWS):
        own = now.select("kind", "plain").distinct()
        per = now.groupBy("kind", "made").agg(F.min("plain").alias("first"), F.max("plain").alias("last"))
        clash = per.where("first <> last").join(
            own.withColumnRenamed("plain", "made").withColumn("taken", F.lit(True)), ["kind", "made"], "left"
        ).select("kind", "made", "first", "taken")
        real = per.join(own.withColumnRenamed("plain", "made"), ["kind", "made"]).select(
            "kind", "made", F.lit(None).cast("string").alias("first"), F.lit(True).alias("taken")
        )
        bad = clash.unionByName(real).groupBy("kind", "made").agg(F.min("first").alias("first"), F.max("taken").alias("taken"))
        again, found = cut_counted(
            now.join(bad, ["kind", "made"])
            .where("taken or plain <> first or first is null")
            .select("kind", "shown", F.col("draw") + 1)
            .toDF("kind", "shown", "draw")
        )
        if not found:
            break
        kept = now.join(again.select("kind", "shown"), ["kind", "shown"], "left_anti")
        now, _ = cut_counted(kept.unionByName(with_surrogate(again)))
    redrawn, n = cut_counted(now.where("draw > 0").select("kind", "shown", "draw"))
    return redrawn if n else None


def replace_entities(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds (``kind:count``) of every row."""
    redrawn = drawn_again(docs, key)
    rows = docs.select("doc_id", "text")
    if redrawn is None:
        rows = rows.withColumn("redrawn", F.array().cast("array<struct<shown:string,draw:int>>"))
    else:
        def holds(c: dict) -> dict:
            out = [(t, s) for t, x in zip(c["k"], c["text"]) for s in {s for _, _, _, s in detected(x)}]
            return {"k": [k for k, _ in out], "shown": [s for _, s in out]}

        keyed = rows.withColumn("k", F.xxhash64("text"))
        in_docs = mapped(keyed.select("k", "text"), holds, "k bigint, shown string").join(redrawn.drop("kind"), "shown")
        # written first: its size is known then, and while it is small the texts stay where they are
        per = cut(in_docs.groupBy("k").agg(F.collect_set(F.struct("shown", "draw")).alias("redrawn")))
        rows = keyed.join(per, "k", "left").select("doc_id", "text", "redrawn")

    def replaced(c: dict) -> dict:
        texts, counts, kinds = [], [], []
        for text, again in zip(c["text"], c["redrawn"]):
            draws = {x["shown"]: x["draw"] for x in again or ()}
            found = detected(text)
            out, at = [], 0
            for a, b, kind, shown in found:
                out += [text[at:a], surrogate(kind, shown, key, draws.get(shown, 0))]
                at = b
            texts.append("".join(out) + text[at:] if found else text)
            counts.append(len(found))
            per = {k: sum(f[2] == k for f in found) for k in _ORDER}
            kinds.append(",".join(f"{k}:{n}" for k, n in per.items() if n))
        return {"doc_id": c["doc_id"], "text": texts, "n_entities": counts, "kinds": kinds}

    return mapped(rows, replaced, "doc_id bigint, text string, n_entities bigint, kinds string")
