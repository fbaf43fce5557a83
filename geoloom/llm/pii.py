"""Personal data by weak supervision.

Labelers look at candidate spans and vote for, against or not at all: how strict
the pattern is that fits, a checksum or shape, a gazetteer of the kind, context
words of the kind, and signs of a placeholder. Words of gazetteers and context
match as whole words. No labeler is trusted beforehand. Expectation-maximisation
over the counts of vote patterns estimates, for each kind of its own, how often
each labeler is right; kinds with few candidates lean on the estimate over all
kinds. The resulting probabilities train a logistic classifier over span features
and votes, which decides on the candidates outside the base kinds.

Base spans (email, ip, card, phone) are exact patterns, vote like all others, and
are always kept. Only counts of (kind, votes, features) reach the driver, whose
number is bounded by the number of kinds, labelers and features, never by the
table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.storage import job, materialize, result

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds.
OWN_KINDS = ("account", "secret", "phone_plain", "iban", "national_id", "person", "address")
ALL_KINDS = KINDS + OWN_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match that begins inside a run of digits could begin with the run, so runs are tried at their start only.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{16,}+)")
#: Secrets that their beginning gives away.
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]++)?)")
_ISSUERS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ")
_PLAIN = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

#: Gazetteers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Señor", "Señora")
GIVEN = (
    "James", "John", "Robert", "Michael", "William", "David", "Thomas", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah",
    "Hans", "Peter", "Klaus", "Wolfgang", "Jürgen", "Stefan", "Ursula", "Petra", "Sabine", "Monika", "Heike", "Anna",
    "Jean", "Pierre", "Michel", "Philippe", "Nicolas", "Marie", "Nathalie", "Isabelle", "Sylvie", "Catherine",
    "José", "Antonio", "Manuel", "Francisco", "Carlos", "Javier", "María", "Carmen", "Ana", "Isabel", "Laura",
)
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Boulevard", "Blvd", "Square", "Court")
WAYS = ("Calle", "Avenida", "Plaza", "Paseo", "Rue", "Avenue", "Boulevard", "Place")
WAY_ENDS = ("straße", "strasse", "weg", "platz", "allee", "gasse")
CITIES = ("London", "Paris", "Berlin", "Madrid", "Lyon", "München", "Hamburg", "Barcelona", "Sevilla", "Boston", "Chicago", "Dublin", "Wien", "Zürich", "Marseille", "Köln")
MAIL_HOSTS = ("gmail", "yahoo", "hotmail", "outlook", "icloud", "gmx", "proton", "mail", "aol", "orange", "web")
#: Words near a span that speak for a kind.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "client", "addr", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "karte", "carte", "payment"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "telefon", "téléphone", "teléfono", "cell"),
    "account": ("card", "account", "visa", "credit", "tarjeta", "konto", "carte", "compte", "cuenta"),
    "secret": ("token", "secret", "key", "password", "passwd", "auth", "credential", "bearer", "api"),
    "phone_plain": ("phone", "call", "tel", "fax", "mobile", "telefon", "téléphone", "teléfono", "cell"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "bic", "swift"),
    "national_id": ("ssn", "social", "security", "passport", "id", "identity", "tax"),
    "person": ("name", "contact", "by", "from", "dear", "signed", "author", "sincerely", "regards", "lives", "born"),
    "address": ("address", "lives", "live", "home", "visit", "ship", "adresse", "dirección", "at", "resident"),
}
NEAR = 40


def whole(words: tuple[str, ...], flags: int = 0) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)", flags)


_CONTEXT = {kind: whole(words, re.IGNORECASE) for kind, words in CONTEXT.items()}
_CITY, _GIVEN, _MAIL_HOST = whole(CITIES), whole(GIVEN), whole(MAIL_HOSTS)
_NAME = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+"
_PERSON = re.compile(rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.?\x20(?P<titled>{_NAME}(?:\x20{_NAME}){{0,2}})|(?P<given>(?:{'|'.join(GIVEN)})(?:\x20{_NAME}){{1,2}}))(?!\w)")
_ADDRESS = re.compile(
    rf"(?<!\w)(?:[0-9]{{1,5}}[A-Za-z]?,?\x20(?:{_NAME}\x20){{1,3}}(?:{'|'.join(STREETS)})"
    rf"|(?:{'|'.join(WAYS)})\x20(?:(?:de|del|des|du|la|las|los|le|les)\x20){{0,2}}{_NAME}(?:\x20{_NAME}){{0,2}},?\x20[0-9]{{1,5}}"
    rf"|[A-ZÄÖÜ][a-zäöüß]+(?:{'|'.join(WAY_ENDS)})\x20[0-9]{{1,4}}[a-z]?)(?!\w)"
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the base pattern, found from each @, so that long runs of letters cost one look."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append((begin, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) < 4 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group()) if m.end() - m.start() <= 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def iban_ok(s: str) -> bool:
    """The remainder of the account number by 97."""
    plain = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|test|x{4,}|0{6,}|12345678|abcdef|your|changeme|placeholder")


def votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """One vote a labeler: 1 for, -1 against, 0 none."""
    span, before, behind = text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]
    digits = [c for c in span if "0" <= c <= "9"]
    pattern = check = place = 0
    if kind == "email":
        host = span.rpartition("@")[2]
        pattern, check, place = (1 if 2 <= len(host.rpartition(".")[2]) <= 6 else -1), (1 if span[0].isalpha() else 0), (1 if _MAIL_HOST.search(host) else 0)
    elif kind == "ip":
        parts = span.split(".")
        pattern, check = (-1 if any(len(x) > 1 and x[0] == "0" for x in parts) else 1), (-1 if parts[0] in ("0", "10", "127", "255") else 1)
    elif kind == "card":
        pattern, check = (1 if span[0] in "3456" else 0), 1
    elif kind in ("phone", "phone_plain"):
        pattern, check = (1 if "(" in span else 0), (1 if 9 <= len(digits) <= 13 else -1)
    elif kind == "account":
        pattern, check = (1 if span[0] in "3456" else 0), (1 if luhn("".join(digits)) else -1)
    elif kind == "secret":
        issued = span.startswith(_ISSUERS)
        pattern, check, place = (1 if len(span) >= 20 else 0), (1 if entropy(span) >= 3 else -1), (1 if issued else 0)
    elif kind == "iban":
        pattern, check = (1 if 15 <= len(span.replace(" ", "")) <= 34 else -1), (1 if iban_ok(span) else -1)
    elif kind == "national_id":
        pattern, check = 1, (-1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1)
    elif kind == "person":
        pattern, check, place = (1 if re.search(rf"(?:{'|'.join(TITLES)})\.?\x20$", before) else 0), (1 if " " in span else 0), (1 if _GIVEN.search(span) else 0)
    elif kind == "address":
        pattern, check, place = 1, (1 if 1 <= len(digits) <= 4 else -1), (1 if _CITY.search(behind) or re.match(r",?\x20[0-9]{4,5}(?![0-9])", behind) else 0)
    context = 1 if _CONTEXT[kind].search(before) or _CONTEXT[kind].search(behind) else 0
    letters = [c for c in span if c.isalnum()]
    placeholder = -1 if len(set(letters)) <= 3 or _PLACEHOLDER.search(span) else 0
    return pattern, check, place, context, placeholder


def features(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """Coarse properties of a span, bounded in number, for the classifier."""
    span = text[a:b]
    before = text[a - 1] if a else " "
    return (ALL_KINDS.index(kind), min(3, (b - a) // 12), int(before.isspace()), int(b == len(text) or text[b : b + 1].isspace()), int(any(c.isalpha() for c in span)), int(any(c in " -." for c in span)))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans the base kinds leave out; none overlaps a base span or another. Of overlapping ones the first counts, of those that begin together the longest."""
    found = [("secret", *m.span(1)) for m in _SECRET.finditer(text)] if "=" in text or ":" in text else []
    if any(x in text for x in _ISSUERS):
        found += [("secret", *m.span()) for m in _ISSUED.finditer(text)]
    if _DIGIT.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 64 and 13 <= sum(c.isdigit() for c in m.group()) <= 19:
                found.append(("account", *m.span()))
        for kind, pattern in (("phone_plain", _PLAIN), ("iban", _IBAN), ("national_id", _NATIONAL), ("address", _ADDRESS)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    found += [("person", *m.span(m.lastgroup)) for m in _PERSON.finditer(text)]
    if not found:
        return []
    taken = sorted((a, b) for _, a, b in base)
    reach, ends = 0, []  # furthest end of the base spans up to each
    for _, b in taken:
        reach = max(reach, b)
        ends.append(reach)
    starts = [a for a, _ in taken]
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        k = bisect_left(starts, b)  # base spans that begin before the end
        if (not k or ends[k - 1] <= a) and (not out or out[-1][2] <= a):
            out.append((kind, a, b))
    return out


SPANS = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,features:array<int>>>"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and candidates of each text, in this order, with the labelers' votes and the features."""
    ints = pa.list_(pa.int32())
    for batch in batches:
        rows, sizes = [], []
        for text in batch["text"].to_pylist():
            base = base_spans(text) if text else []
            own = [*base, *candidates(text, base)] if text else []
            sizes.append(len(own))
            rows += [(ALL_KINDS.index(k), a, b, n < len(base), votes(k, text, a, b), features(k, text, a, b)) for n, (k, a, b) in enumerate(own)]
        columns = list(zip(*rows)) if rows else [()] * 6
        fields = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), ints, ints))]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["kind", "start", "end", "base", "votes", "features"]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), spans], ["doc_id", "spans"])


#: Candidates that the estimate over all kinds counts for in the estimate of one.
LEAN = 4.0


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 50, around: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation for independent labelers: P(true) of each vote pattern, and each labeler's chances of its votes given true, and given false. ``around`` holds such chances to lean on."""
    p = np.clip(0.5 + 0.25 * v.sum(axis=1), 0.05, 0.95)
    lean = [LEAN * x for x in around] if around is not None else [0.5, 0.5]
    like = lambda q, add: np.stack([(n[:, None] * q[:, None] * (v == x)).sum(axis=0) for x in (-1, 0, 1)]) + add
    for _ in range(rounds):
        yes, no = like(p, lean[0]), like(1 - p, lean[1])
        yes, no = yes / yes.sum(axis=0), no / no.sum(axis=0)
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        at = np.arange(v.shape[1])
        logit = np.log(prior / (1 - prior)) + (np.log(yes[v + 1, at]) - np.log(no[v + 1, at])).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, yes, no


def expand(f: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Indicator columns of features, votes, and votes by kind, and a constant."""
    sizes = (len(ALL_KINDS), 4, 2, 2, 2, 2)
    cols = [(f[:, k] == x).astype(float) for k, size in enumerate(sizes) for x in range(size)]
    said = [(v[:, k] == x).astype(float) for k in range(v.shape[1]) for x in (-1, 1)]
    cols += said + [(f[:, 0] == kind) * x for kind in range(len(ALL_KINDS)) for x in said]
    return np.stack([*cols, np.ones(len(f))], axis=1)


def train(scanned: DataFrame) -> tuple[np.ndarray, dict[str, list[np.ndarray]]]:
    """Weights of the span classifier, and by kind the labelers' chances of their votes given true and false, from all spans of ``scanned``."""
    rows = scanned.select(F.inline("spans")).groupBy("votes", "features").agg(F.count("*").alias("n")).collect()  # as many as patterns are possible
    if not rows:
        return np.zeros(0), {}
    rows.sort(key=lambda r: (r["votes"], r["features"]))
    v, f = np.array([r["votes"] for r in rows]), np.array([r["features"] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    _, *all_kinds = reliabilities(v, n)
    p, of_kind = np.zeros(len(n)), {}
    for k in np.unique(f[:, 0]):
        own = f[:, 0] == k
        p[own], *of_kind[ALL_KINDS[k]] = reliabilities(v[own], n[own], around=all_kinds)
    x = expand(f, v)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        y = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * y * (1 - y) + 1e-9)[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - y)) - w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, of_kind


def judge(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Base spans as they are, and the candidates that the classifier accepts."""
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["spans"].to_pylist()
            own = [s for spans in found for s in spans if not s["base"]]
            if own:
                x = expand(np.array([s["features"] for s in own]), np.array([s["votes"] for s in own]))
                for s, q in zip(own, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()):
                    s["p"] = q
            named = [[{"kind": ALL_KINDS[s["kind"]], "start": s["start"], "end": s["end"], "p": s.get("p", 1.0), "base": s["base"]} for s in spans] for spans in found]
            base, added = ([[s for s in spans if s["base"] == is_base and s["p"] >= 0.5] for spans in named] for is_base in (True, False))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, span_type), pa.array(added, span_type)], names=["doc_id", "base", "added"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (spans of the base kinds), added (spans the classifier accepts).

    Spans count code points, end exclusive. Null text is empty and has no span.
    Texts of any length are searched whole, once: spans are written with their votes,
    counted, and judged. Repeated rows get a result each, and count as often in
    training; an empty table gives an empty result; further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with job(docs.sparkSession):
        scanned = materialize(texts.mapInArrow(scan, f"doc_id bigint, spans {SPANS}"), "spans")
        kind = "array<struct<kind:string,start:bigint,end:bigint,p:double>>"
        return result(scanned.mapInArrow(judge(train(scanned)[0]), f"doc_id bigint, base {kind}, added {kind}"), "pii")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    text = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, rank)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    size = lambda *c: F.size(F.concat(*c)).cast("bigint")
    return found.select("doc_id", *n, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), size("base", "added").alias("n_spans"), (size("base", "added") > 0).alias("has_pii"))
