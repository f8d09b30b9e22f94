"""Personal data by weak supervision.

Candidates come from regular expressions (email, ip, card, phone: always kept, they are the base), and from looser
shapes: phone and card numbers that stand next to other digits, which the base reads as one number that is too long,
national phone numbers, social security numbers, IBANs, spelled-out emails, street addresses, and pairs of capitalised
words that a gazetteer or the context speaks for. Labelers (shape and checksum, gazetteer, context before, neighbours)
vote -1, 0 or 1 on each candidate. Expectation maximisation over the counts of all vote patterns of the corpus
estimates the labelers' reliabilities for each kind, and the posteriors train a logistic span classifier, which
decides about the candidates that are not base.

A candidate is known by its kind and a pattern of votes and features, of which there are fewer than PATTERNS for each
kind whatever the size of the corpus: only counts of patterns reach the driver. Gazetteers are parameters; the lists
here are short defaults.

Null and empty texts have no spans; every row of the input, repeated ones too, gives one row, an empty table none; spans
that start together stand in the order of their kinds; other columns are not read, whatever their names. Texts are read
whole, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, texts_at_a_time

KINDS = ["email", "ip", "card", "phone", "tel", "ssn", "iban", "mail_words", "street", "person", "pan"]
BASE = 4

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A match begins where digits begin, so other places need not be tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_TEL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9.-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_AT = re.compile(r"\x20?[\[(]\x20?at\x20?[\])]")
_DOMAIN_WORDS = re.compile(r"\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]+)+")
_LOCAL_WORDS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-"
_STREET = re.compile(r"\b[0-9]{1,5}\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|Avenue|Road|Boulevard|Lane|Drive|St|Ave|Rd|Blvd)\b")
_PERSON = re.compile(r"\b[A-Z][a-z]+\x20[A-Z][a-z]+(?:-[A-Z][a-z]+)?\b")

GIVEN_NAMES = frozenset("Alice Anna Barbara Carlos Carmen Charles Claire Daniel David Elena Elizabeth Emily Emma Francois Hans Isabel Jack James Javier Jean Jennifer Jessica Joan Johann John Jose Joseph Juan Julia Karen Karl Klaus Laura Linda Luis Maria Marie Martin Mary Michael Michel Nicole Patricia Paul Pedro Peter Pierre Richard Robert Sarah Sofia Stefan Susan Thomas William".split())
#: Capitalised words that begin no name.
NO_NAMES = frozenset("The This That These Those A An In On At By For From With New North South East West United Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Der Die Das Le La Les El Los Las Un Une Una".split())
TOP_DOMAINS = frozenset("com org net edu gov io info biz de fr es uk it nl ch at be us ca au eu co me dev app".split())

CUES = re.compile(r"(?i)e-?mail|mailto|correo|contact|phone|\btel\b|telefon|t[ée]l[ée]phone|tel[ée]fono|\bcall\b|mobile|\bfax\b|\bcard\b|visa|mastercard|karte|tarjeta|carte|\bip\b|server|\bhost|\bssn\b|social security|\biban\b|konto|compte|cuenta|address|adresse|direcci|\bname\b|\bmr\b|\bmrs\b|\bdr\b|herr|frau|monsieur|madame|se[ñn]or")
DENIALS = re.compile(r"(?i)version|\bv\.?$|isbn|\border\b|invoice|serial|\bpart\b|\bno\.$|\bid\b|page|section|example|figure|fig\.")

NEAR = 40
VOTES = 4
FEATURES = 4
PATTERNS = 3**VOTES * 2**FEATURES


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base, unsorted. Leftmost, non-overlapping within each kind."""
    out = []
    at, after = text.find("@"), 0
    while at >= 0:
        stem = text[after:at]
        start = after + len(stem.rstrip(_LOCAL))
        match = _EMAIL.match(text, start) if start < at else None
        if match:
            out.append((start, 0, match.end()))
            after = match.end()
        else:
            after = at + 1
        at = text.find("@", after)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


_GROUP = re.compile(r"[0-9]+")


def cut_spans(text: str) -> list[tuple[int, int, int]]:
    """Numbers inside what the base's patterns take as one number with too many digits: from its start, the longest
    phone number that ends before a space; and the leftmost, longest runs of whole groups that make a card number."""
    out = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            if sum(map(str.isdigit, m[0])) > 15:
                digits, end = 0, -1
                for i, c in enumerate(m[0]):
                    if c == " " and 10 <= digits and m[0][i - 1].isdigit():
                        end = i
                    digits += c.isdigit()
                    if digits > 15:
                        break
                if end >= 0:
                    out.append((m.start(), 4, m.start() + end))
    for m in _CARD.finditer(text):
        if sum(map(str.isdigit, m[0])) > 19:
            out += card_runs(text, m.start(), m.end())
    return out


def card_runs(text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """Leftmost, longest runs of whole groups of digits that make a card number, in a stretch of digits and gaps."""
    groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, start, end)]
    digits = np.array([int(c) for c in text[start:end] if c.isdigit()])
    ends = np.cumsum([b - a for a, b in groups]).tolist()
    begins = [0, *ends[:-1]]
    twice = np.where(digits > 4, 2 * digits - 9, 2 * digits)
    odd = np.arange(len(digits)) % 2 == 1
    # Check sums up to each digit, by the parity of the last digit, which counts once.
    sums = [np.append(0, np.cumsum(np.where(odd == last, digits, twice))).tolist() for last in (False, True)]
    out, i = [], 0
    while i < len(groups):
        fits, a = None, begins[i]
        for j in range(i, len(groups)):
            b = ends[j]
            if b - a > 19:
                break
            if b - a >= 14:
                s = sums[(b - 1) % 2]
                if (s[b] - s[a]) % 10 == 0:
                    fits = j
        if fits is None:
            i += 1
        else:
            out.append((groups[i][0], 10, groups[fits][1]))
            i = fits + 1
    return out


def spelled_emails(text: str) -> list[tuple[int, int, int]]:
    out, after = [], 0
    for m in _AT.finditer(text):
        local = text[after : m.start()]
        local = local[len(local.rstrip(_LOCAL_WORDS)) :].lstrip("._-")
        domain = _DOMAIN_WORDS.match(text, m.end()) if local else None
        if domain:
            out.append((m.start() - len(local), 7, domain.end()))
        after = domain.end() if domain else m.end()
    return out


def loose_spans(text: str, names: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int, int]]:
    out = []
    if _DIGIT.search(text):
        taken = sorted(cut_spans(text))
        out += taken
        i = reach = 0
        for m in _TEL.finditer(text):
            while i < len(taken) and taken[i][0] < m.end():
                reach = max(reach, taken[i][2])
                i += 1
            if reach <= m.start() and 8 <= sum(map(str.isdigit, m[0])) <= 13:
                out.append((m.start(), 4, m.end()))
        if "-" in text:
            out += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
        out += [(m.start(), 6, m.end()) for m in _IBAN.finditer(text)]
        out += [(m.start(), 8, m.end()) for m in _STREET.finditer(text)]
    out += spelled_emails(text)
    out += [(m.start(), 9, m.end()) for m in _PERSON.finditer(text) if m[0].split(" ")[0] in names or CUES.search(text, max(0, m.start() - NEAR), m.start())]
    return out


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def shape_vote(name: str, span: str, after: str) -> int:
    digits = "".join(c for c in span if c.isdigit())
    if name == "email":
        local, _, domain = span.partition("@")
        return -1 if local[0] == "." or local[-1] == "." or ".." in local or not domain.rsplit(".", 1)[-1].isalpha() else 1
    if name == "ip":  # versions go on with a point, or have leading zeros
        return -1 if after[:1] == "." and after[1:2].isdigit() or any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1
    if name in ("card", "pan"):
        return 1 if luhn(digits) and digits[0] in "3456" and len(digits) in (14, 15, 16, 19) else 0
    if name == "phone":
        return -1 if digits[0] == "0" or span.count("(") != span.count(")") else 1
    if name == "iban":
        return 1 if _iban(span) else -1
    if name == "ssn":
        return -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    return 0


def pattern(text: str, start: int, kind: int, end: int, near: bool, names: frozenset[str] = GIVEN_NAMES) -> int:
    """The labelers' votes (base 3, 1 for none) and below them the features (bits) of a candidate."""
    span, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + 12]
    name = KINDS[kind]
    listed = 0
    if name in ("email", "mail_words"):
        listed = 1 if re.split(r"[.\x20\])]+", span)[-1].lower() in TOP_DOMAINS else -1
    elif name == "ip":
        listed = -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif name == "person":
        words = span.split(" ")
        listed = 1 if words[0] in names else -1 if words[0] in NO_NAMES or words[1] in NO_NAMES else 0
    elif name == "tel":
        listed = 1 if span.startswith(("0", "(", "+")) else 0
    context = -1 if DENIALS.search(before) else 1 if CUES.search(before) else 0
    votes = (shape_vote(name, span, after), listed, context, int(near))
    clean = not before[-1:].isalnum() and not after[:1].isalnum()
    features = (clean, len(span) >= 12, sum(map(str.isdigit, span)) * 2 > len(span), bool(CUES.search(after)))
    number = 0
    for v in votes:
        number = number * 3 + v + 1
    for f in features:
        number = number * 2 + f
    return number


def unpack(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (0, 1, 2) and features (0, 1) of patterns."""
    features = np.stack([number >> i & 1 for i in range(FEATURES - 1, -1, -1)], axis=1)
    rest = number >> FEATURES
    votes = np.stack([rest // 3**i % 3 for i in range(VOTES - 1, -1, -1)], axis=1)
    return votes, features


def candidates(text: str, names: frozenset[str] = GIVEN_NAMES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and (start, kind, end, pattern) of all candidates; loose ones that touch a base span are none."""
    base = sorted(base_spans(text))
    loose = sorted(loose_spans(text, names))
    if loose:
        kept, i, reach = [], 0, 0
        for x in loose:
            while i < len(base) and base[i][0] < x[2]:
                reach = max(reach, base[i][2])
                i += 1
            if reach <= x[0]:
                kept.append(x)
        loose = kept
    spans = sorted(base + loose)
    out = []
    for i, (start, kind, end) in enumerate(spans):
        near = i > 0 and start - spans[i - 1][2] < 80 or i + 1 < len(spans) and spans[i + 1][0] - end < 80
        out.append((start, kind, end, pattern(text, start, kind, end, near, names)))
    return base, out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """doc_id, base (kind:start:end of each), counts of the base, and cands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_at_a_time(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                base, cands = candidates(text, names)
                n = [sum(k == i for _, k, _ in base) for i in range(BASE)]
                rows.append((",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base), n, cands))
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())]))
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[1][i] for r in rows], pa.int64()) for i in range(BASE))]
            columns.append(pa.array([[dict(zip(("start", "kind", "end", "pattern"), c, strict=True)) for c in r[2]] for r in rows], kinds))
            yield pa.record_batch(columns, names=["doc_id", "base", "n_email", "n_ip", "n_card", "n_phone", "cands"])

    schema = "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, cands array<struct<start int, kind int, end int, pattern int>>"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern, and P(vote | truth) as [truth, kind, labeler, vote], by expectation maximisation."""
    post = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(axis=1)))
    table = np.zeros((2, len(KINDS), VOTES, 3))
    # A labeler is taken to be right more often than wrong until the data say otherwise.
    lean = np.array([[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]])
    for _ in range(rounds):
        prior = np.zeros(len(KINDS))
        for k in range(len(KINDS)):
            mine = kinds == k
            w = counts[mine]
            prior[k] = ((post[mine] * w).sum() + 1) / (w.sum() + 2)
            for y in (0, 1):
                p = (post[mine] if y else 1 - post[mine]) * w
                for j in range(VOTES):
                    got = np.bincount(votes[mine, j], p, 3) + lean[y]
                    table[y, k, j] = got / got.sum()
        odds = np.log(prior[kinds] / (1 - prior[kinds]))
        for j in range(VOTES):
            odds += np.log(table[1, kinds, j, votes[:, j]] / table[0, kinds, j, votes[:, j]])
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, table


def design(kinds: np.ndarray, votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    return np.hstack([np.eye(len(KINDS))[kinds], votes == 2, votes == 0, features]).astype(float)


def span_classifier(x: np.ndarray, post: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model of the posteriors, by Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    scale = counts / max(counts.sum(), 1) * min(counts.sum(), 10_000)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (scale * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (scale * (post - p)) - w)
    return w


def accepted(patterns: list[tuple[int, int, int]], threshold: float = 0.5) -> list[int]:
    """kind * PATTERNS + pattern of what the classifier accepts, from (kind, pattern, count) over the corpus."""
    if not patterns:
        return []
    kinds, numbers, counts = (np.array(x) for x in zip(*sorted(patterns), strict=True))
    votes, features = unpack(numbers)
    post, _ = reliabilities(kinds, votes, counts)
    x = design(kinds, votes, features)
    p = 1 / (1 + np.exp(-x @ span_classifier(x, post, counts)))
    return (kinds * PATTERNS + numbers)[p >= threshold].tolist()


def find(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", names: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, cands with a flag `kept`."""
    found = scratch.save(scan(df, id_col, text_col, names), "scan")
    counts = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.pattern").count().collect()
    good = accepted([(r.kind, r["pattern"], r["count"]) for r in counts])
    key = lambda c: c["kind"] * PATTERNS + c["pattern"]
    ok = F.array(*map(F.lit, good)) if good else F.array().cast("array<int>")
    return found.withColumn("spans", F.filter("cands", lambda c: (c["kind"] < BASE) | F.array_contains(ok, key(c))))


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    names = F.array(*map(F.lit, KINDS))
    text = F.transform("spans", lambda c: F.concat(F.get(names, c["kind"]), F.lit(":"), c["start"].cast("string"), F.lit(":"), c["end"].cast("string")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), F.array_join(text, ",").alias("spans"))
