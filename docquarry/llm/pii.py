"""Personal data by weak supervision (DataFrame functions only).

Candidate spans come from the base patterns and from looser ones.  Labelers of four sorts vote on
each: its pattern, its inner form (check digits, octets), a gazetteer and the words before it.  The
votes' patterns are counted over the whole corpus; expectation-maximisation estimates from these
counts how reliable each labeler is, and its posteriors train a logistic span classifier, which
decides on the looser candidates.  Base spans always stay.

Quantifiers are possessive and starts anchored wherever that can't change a match, so that long runs
of digits or letters cost linear time.  Each pattern goes over a text once; places are running sums in
chunks, so that texts with many matches stay cheap too.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, cut, table

KINDS = ("email", "ip", "card", "phone", "secret", "name")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs only, of as many digits as count: other runs never pass
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?i:dot)[\])] ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "card": r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:token|api[_-]?key|secret|passwd|password) ?[:=] ?[\"']?[a-z0-9+/_-]{16,128}+",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?",
}
# --- fixed values: what the gazetteer and context labelers know
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "io", "dev", "app", "biz", "co", "me", "tv", "cloud", "online", "site", "shop", "test", "example",
    "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl", "be", "lu", "ie", "pt", "dk", "se", "no", "fi", "pl", "cz", "sk", "hu", "ro", "gr", "tr", "ua", "ru",
    "us", "ca", "mx", "br", "ar", "cl", "pe", "cn", "jp", "kr", "in", "sg", "hk", "tw", "th", "vn", "id", "au", "nz", "za", "il", "ae",
)
FIRST_NAMES = (
    "Alice", "Ana", "Andrea", "Andrew", "Anna", "Anne", "Antonio", "Barbara", "Carlos", "Carol", "Charles", "Christian", "Claire", "Daniel", "David", "Diego", "Elena", "Elizabeth", "Emily", "Emma",
    "Erik", "Eva", "Francesco", "Frank", "Fritz", "George", "Greta", "Hans", "Heinrich", "Helen", "Henry", "Ines", "Isabel", "Jack", "Jacques", "James", "Jane", "Jean", "Jennifer", "Johann",
    "John", "Jose", "Joseph", "Juan", "Julia", "Karen", "Karl", "Kevin", "Klaus", "Laura", "Linda", "Lisa", "Louis", "Lucia", "Luis", "Manuel", "Marco", "Margaret", "Maria", "Marie",
    "Mark", "Martin", "Mary", "Michael", "Michel", "Miguel", "Nancy", "Nicolas", "Olivia", "Pablo", "Patricia", "Paul", "Peter", "Philippe", "Pierre", "Rachel", "Ralf", "Richard", "Robert", "Rosa",
    "Sabine", "Samuel", "Sarah", "Sergio", "Sofia", "Sophie", "Stefan", "Stephen", "Susan", "Teresa", "Thomas", "Ursula", "Victor", "Walter", "William", "Wolfgang",
)
CONTEXT = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel", "ip": r"\bip\b|server|host|address|client|from|login", "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|contact|number", "secret": "auth|login|credential|config|export", "name": "dear|contact|patient|signed|sincerely|regards",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
CONTEXT_CHARS = 40
#: Stands before and after matches while they are told apart; where a text has it, another sign takes its place.
MARK, INSTEAD = "\ue000", "\ue001"
SPANS = "array<struct<start:int,end:int,match:string,before:string>>"


def running(values: Column, first: int, op: Callable[[Column, Column], Column]) -> Column:
    """For every value, what ``op`` makes of all values before it, from ``first`` on.

    In chunks of about the root of their number: an array can only grow by being copied.
    """
    nothing = F.array().cast("array<int>")

    def scan(of: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(of, F.struct(F.lit(first).alias("at"), nothing.alias("out")), step)

    def whole(of: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(of))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / size).cast("int")), lambda i: scan(F.slice(of, i * size + 1, size)))
        lifted = lambda c: F.zip_with(c, scan(F.transform(c, lambda x: x["at"]))["out"], lambda x, at: F.transform(x["out"], lambda v: op(at, v)))
        return F.flatten(bound(chunks, lifted))

    return F.when(F.size(values) > 0, bound(values, whole)).otherwise(nothing)


def found_at(text: Column, pattern: str) -> Column:
    """Leftmost matches as ``(start, end, match, before)`` in code points, end exclusive; ``before`` are the
    signs before it, back to the match before.  The text must be without ``MARK``."""
    marked = F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")

    def spans(parts: Column) -> Column:
        sums = running(F.transform(parts, lambda p: F.length(p)), 0, lambda a, b: a + b)
        places = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        one = lambda at: lambda i: F.struct(
            F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), F.get(parts, i).alias("match"), F.right(F.get(parts, i - 1), F.lit(CONTEXT_CHARS)).alias("before")
        )
        return bound(sums, lambda at: F.transform(places, one(at)))

    cut_up = lambda parts: F.when(F.size(parts) > 1, spans(parts)).otherwise(F.array().cast(SPANS))
    return bound(F.split(marked, MARK, -1), cut_up)


def uncovered(loose: Column, base: Column) -> Column:
    """The spans of ``loose`` that overlap none of ``base``, in order of their places.

    All spans in order: what is before a span may reach into it, or what comes next may begin in it.
    """
    tagged = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s.alias("span")))
    far = 2**31 - 1

    def apart(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda r: F.when(r["own"], F.lit(0)).otherwise(r["end"])), 0, lambda a, b: F.greatest(a, b))
        after = F.reverse(running(F.reverse(F.transform(rows, lambda r: F.when(r["own"], F.lit(far)).otherwise(r["start"]))), far, lambda a, b: F.least(a, b)))
        keep = lambda r, b: r["own"] & (b["reach"] <= r["start"]) & (b["next"] >= r["end"])
        pick = lambda both: F.filter(F.zip_with(rows, both, lambda r, b: F.when(keep(r, b), r["span"])), lambda s: s.isNotNull())
        return pick(F.zip_with(reach, after, lambda a, b: F.struct(a.alias("reach"), b.alias("next"))))

    every = F.array_sort(F.concat(tagged(base, False), tagged(loose, True)))
    return F.when((F.size(loose) > 0) & (F.size(base) > 0), bound(every, apart)).otherwise(loose)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def value(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The base rules for a match."""
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(match)).between(14, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def vote(yes: Column, no: Column | None = None) -> Column:
    """1 for yes, 2 for no, 0 for abstaining."""
    return F.when(yes, 1).when(no, 2).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)


def votes(kind: str, base: bool, span: Column) -> list[Column]:
    """Pattern, inner form, gazetteer and context, for one candidate."""
    m, before = span["match"], F.lower(span["before"])
    form = {
        "email": lambda: m.rlike(r"(?i)[a-z]{2,}$"), "ip": lambda: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "card": lambda: F.length(digits(m)).between(14, 19) & luhn(digits(m)),
        "phone": lambda: F.length(digits(m)).between(10, 15), "secret": lambda: m.rlike("[0-9]") & m.rlike("[:=].*[A-Za-z]"), "name": lambda: m.rlike(r"\. \S+ \S+"),
    }[kind]()
    listed = {
        "email": lambda: vote(m.rlike(rf"(?i)[.) ](?:{'|'.join(DOMAINS)})$")), "ip": lambda: vote(~m.rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."), m.isNotNull()), "card": lambda: vote(m.rlike("^[3-6]"), m.isNotNull()),
        "phone": lambda: vote(digits(m).rlike("^[1-9]")), "secret": lambda: vote(m.rlike("(?i)^(?:token|api|secret|pass)")), "name": lambda: vote(m.rlike(rf" (?:{'|'.join(FIRST_NAMES)})\b")),
    }[kind]()
    return [vote(F.lit(base)), vote(form, ~form), listed, vote(before.rlike(CONTEXT[kind]))]


def code(kind: str, ballot: list[Column]) -> Column:
    """Kind and votes as one number."""
    out = F.lit(KINDS.index(kind))
    for v in ballot:
        out = out * 3 + v
    return out


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior probability that a vote pattern ``(kind, votes...)`` is personal data.

    Labelers err independently given the truth; each has its own chances of yes, no and abstaining
    for either truth, and each kind its own share.  Priors say that labelers are better than chance.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    table = np.array(keys)
    kind, ballots = table[:, 0], table[:, 1:]
    post = np.clip(0.5 + 0.2 * ((ballots == 1).sum(1) - (ballots == 2).sum(1)), 0.05, 0.95)
    prior = np.array([[2.0, 1.0, 2.0], [2.0, 4.0, 1.0]])  # rows: false, true; columns: abstains, yes, no
    for _ in range(rounds):
        share = np.array([(n * post)[kind == k].sum() + 1 for k in range(len(KINDS))]) / np.array([n[kind == k].sum() + 2 for k in range(len(KINDS))])
        log = np.stack([np.log(1 - share[kind]), np.log(share[kind])])
        for j in range(ballots.shape[1]):
            for truth, weight in ((0, 1 - post), (1, post)):
                c = np.array([(n * weight)[ballots[:, j] == v].sum() for v in range(3)]) + prior[truth]
                log[truth] += np.log(c / c.sum())[ballots[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(keys, post.tolist(), strict=True))


def features(key: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(key[0] == k) for k in range(len(KINDS))), *(float(v == s) for v in key[1:] for s in (1, 2))]


def fit_classifier(counts: dict[tuple[int, ...], int], posterior: dict[tuple[int, ...], float], ridge: float = 0.1) -> np.ndarray:
    """Logistic weights on kind and votes, from the posteriors as soft labels."""
    keys = sorted(counts)
    x, y, n = np.array([features(k) for k in keys]), np.array([posterior[k] for k in keys]), np.log1p(np.array([counts[k] for k in keys], float))
    t = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(t)), x.T @ (n * (p - y)) + ridge * t)
        t -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return t


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start and then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``.

    Base spans are the leftmost non-overlapping matches of each kind that pass its rules; looser
    candidates that overlap none of them are added to ``spans`` where the classifier gives them at
    least ``threshold``.  ``n_spans`` counts them all, of every kind.  Null and empty texts have no
    spans (an empty string, and its hash); an empty table gives no rows.  Texts of any length count
    whole.  Repeated rows stay repeated; ids and other columns play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id"), F.when(text.contains(MARK), F.translate(text, MARK, INSTEAD)).otherwise(text).alias("t"))
    guards = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+")}
    texts = texts.select("doc_id", *(F.when(guards.get(k, F.lit(True)), found_at(F.col("t"), p)).otherwise(F.array().cast(SPANS)).alias(f"b_{k}") for k, p in BASE.items()), *(found_at(F.col("t"), p).alias(f"l_{k}") for k, p in LOOSE.items()))
    texts = texts.select("doc_id", *(_passing(k).alias(f"b_{k}") for k in BASE), *(f"l_{k}" for k in LOOSE))
    texts = texts.select("doc_id", F.concat(*(_spans(k, True) for k in BASE)).alias("base"), F.concat(*(_spans(k, False) for k in LOOSE)).alias("loose"))
    spans = cut(texts.select("doc_id", "base", uncovered(F.col("loose"), F.col("base")).alias("loose")))
    patterns = spans.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy("s.code").count().collect()  # at most kinds times 3^4 rows
    keys = {_number(k): k for k in product(range(len(KINDS)), *[range(3)] * 4)}
    counts = {keys[r["code"]]: r["count"] for r in patterns}
    accepted = [-1]
    if counts:
        t = fit_classifier(counts, estimate(counts))
        # what fails its kind's inner form (check digits, octets) is never added
        accepted += [_number(k) for k in counts if k[2] != 2 and 1 / (1 + np.exp(-(np.array(features(k)) @ t))) >= threshold]
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    spans = spans.select("doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.transform("base", plain).alias("base"), F.transform(F.filter("loose", lambda s: s["code"].isin(accepted)), plain).alias("more"))
    return spans.select(
        "doc_id", *(f"n_{k}" for k in BASE), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )


def _passing(kind: str) -> Column:
    return F.filter(f"b_{kind}", lambda s: passes(kind, s["match"]))


def _spans(kind: str, base: bool) -> Column:
    """Candidates with their kind's number and the code of their votes."""
    number = F.lit(KINDS.index(kind))
    return F.transform(f"{'b' if base else 'l'}_{kind}", lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end"), code(kind, votes(kind, base, s)).alias("code")))


def _number(key: tuple[int, ...]) -> int:
    out = 0
    for v in key:
        out = out * 3 + v
    return out


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
