"""Personal data in texts by weak supervision, with DataFrame operations only.

Candidates are the matches of the four base patterns, valid or not, and of looser forms (a telephone
number without a plus sign, a spelled-out mail address). Four labelers vote on each: the base rule, which
abstains on looser forms, its shape, a gazetteer and the words before it. Expectation-maximisation over
the counts of vote patterns, a table of bounded size that Spark sums over all documents, estimates how
reliable the other labelers are where they vote; its posteriors train a logistic classifier of spans on the counts
of feature patterns, in which every form (valid, broken, loose) weighs the same. Valid base matches always
stay; the classifier adds others that don't overlap them.

Matches are leftmost and don't overlap within a kind. Patterns use possessive repeats and start only at
the border of a run, which finds the same matches and takes linear time on long runs. Positions are code
points, the end exclusive. Null and empty texts have no spans; repeated rows give repeated results; an
empty table gives no rows; other columns are kept by ``mask`` and ignored by ``find``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastre.llm.text import whole_text
from cadastre.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: per kind the base pattern, and looser ones that only the classifier can accept
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9_-]{0,40}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,40}+ ?[\[(] ?dot ?[\])] ?[A-Za-z]{2,10}+",
    "phone": r"(?<![0-9+(])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: what a text must hold for a pattern to be tried
GUARDS = {"email": ("@",), "ip": (".",), "card": (), "phone": ("+",)}
#: characters before a match that the context labeler reads
CONTEXT = 40
#: probability from which the classifier adds a span
ACCEPT = 0.9
VOTES = ("v_rule", "v_shape", "v_known", "v_context")
#: how far a vote moves the first guess of its candidate, before reliabilities are known
FIRST = (0.45, 0.1, 0.1, 0.2)
#: belief before the data, P(yes given personal) and P(yes given other). The base rule is a definition (a check
#: digit, a range) and keeps it; the others' counts as a share of their votes and yields to the data
RULE, OTHERS, SHARE = (0.99, 0.02), (0.8, 0.2), 0.05
#: what the classifier sees of a span
FEATURES = ("broken", "loose", "v_known", "cue", "against", "edge", "size")

# fixed values: endings of host names, country codes and cue words
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "us", "eu", "ch", "at", "it", "nl", "jp", "cn", "in", "br", "ca", "au")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98")
CUES = {
    "email": "e?mail|contact|write|reach|kontakt|courriel|correo",
    "ip": "address|host|server|client|login|from ip|adresse",
    "card": "card|visa|credit|payment|account|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|contact|telefon|llame",
}
AGAINST = r"\b(?:version|release|isbn|serial|order|invoice|ticket|build|id)s?\b"


def _matches(text: Column, kind: str, loose: bool) -> Column:
    """Array of (kind, loose, gap, before, m): each match with the length of the gap before it."""
    pattern = (LOOSE if loose else BASE)[kind]
    guards = () if loose else GUARDS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(
        gaps, found,
        lambda g, m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(loose).alias("loose"), F.length(g).alias("gap"), F.lower(F.right(g, F.lit(CONTEXT))).alias("before"), m.alias("m")),
    )
    met = text.rlike(pattern)
    for guard in guards:
        met = (F.instr(text, guard) > 0) & met
    return F.when(met, F.filter(pairs, lambda p: p["m"].isNotNull()))


def candidates(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Checkpointed (id, k, lists): each row's key, a hash of key and text, and its matches by pattern."""
    whole = whole_text(text)
    digit = whole.rlike("[0-9]")
    lists = [_matches(whole, kind, False) if kind == "email" else F.when(digit, _matches(whole, kind, False)) for kind in KINDS]
    lists += [F.when(F.instr(whole, "at") > 0, _matches(whole, "email", True)), F.when(digit, _matches(whole, "phone", True))]
    return cut_lineage(docs.select(F.col(key).alias("id"), row_hash(key, text).alias("k"), F.array_compact(F.array(*lists)).alias("lists")))


def row_hash(key: str, text: str) -> Column:
    return F.struct(F.xxhash64(key, text).alias("a"), F.hash(text, key).alias("b"))


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    values = F.reverse(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int")))
    doubled = F.transform(values, lambda v, k: F.when(k % 2 == 0, v).otherwise(F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)))
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + v) % 10 == 0


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def spans(found: DataFrame) -> DataFrame:
    """One row per candidate: (k, kind, start, end, valid, votes, features), identical rows once."""
    lists = found.where(F.size("lists") > 0).dropDuplicates(["k"]).select("k", F.posexplode("lists").alias("at", "list"))
    each = lists.select("k", "at", F.posexplode("list").alias("i", "c")).select("k", "at", "i", "c.*")
    order = Window.partitionBy("k", "at").orderBy("i")
    n = F.length("m")
    each = each.withColumn("end", F.sum(F.col("gap") + n).over(order)).withColumn("start", F.col("end") - n)
    digits = F.regexp_replace("m", "[^0-9]", "")
    # a run with too few or too many digits is no card or number, nor a case to learn from
    count = F.length(F.regexp_replace("m", "[^0-9]", ""))
    each = each.where(F.when(F.col("kind") == 2, count.between(16, 19)).when(F.col("kind") == 3, count.between(8, 15)).otherwise(True))
    parts = F.transform(F.split("m", r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    is_ip, count = F.col("kind") == 1, F.length(digits)
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).cast("int") <= 255))
    card = F.when(count.between(16, 19), _luhn(digits)).otherwise(False)
    valid = ~F.col("loose") & F.when(F.col("kind") == 0, True).when(is_ip, F.coalesce(small, F.lit(False))).when(F.col("kind") == 2, card).otherwise(count.between(8, 15))
    ending = F.lower(F.regexp_extract("m", r"([A-Za-z]+)$", 1))
    # an area code and an exchange never start with 0 or 1
    area = F.regexp_replace("m", "[^0-9]", "").rlike("^[2-9][0-9]{2}[2-9]")
    even = F.col("m").rlike(r"^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$")
    loose = F.col("loose")
    code = F.coalesce(*[F.when(F.col("m").startswith(f"+{c}"), True) for c in COUNTRIES], F.lit(False))
    of_kind = lambda values: F.when(F.col("kind") == 0, values[0]).when(is_ip, values[1]).when(F.col("kind") == 2, values[2]).otherwise(values[3])
    shape = of_kind([
        _vote(F.length(ending).between(2, 10) & (n <= 80), F.length(ending) == 0),
        _vote((n <= 15) & ~F.col("m").rlike(r"(^|\.)0[0-9]"), n > 15),
        _vote((count == 16) & F.col("m").rlike("^[2-6]"), count > 16),
        F.when(loose, _vote(even, F.lit(False))).otherwise(_vote(count.between(10, 13), count < 10)),
    ])
    known = of_kind([
        _vote(ending.isin(*ENDINGS), F.lit(False)),
        _vote(~F.col("m").rlike(r"^(0|255)\."), F.col("m").rlike(r"^0\.")),
        _vote(F.col("m").rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), F.col("m").rlike("^[01789]")),
        F.when(loose, _vote(area, ~area)).otherwise(_vote(code, F.lit(False))),
    ])
    cue = of_kind([F.col("before").rlike(rf"\b(?:{CUES[k]})") for k in KINDS])
    against = F.col("before").rlike(AGAINST)
    each = each.withColumns({
        "valid": valid, "v_rule": F.when(loose, 0).otherwise(_vote(valid, ~valid)), "v_shape": shape, "v_known": known, "v_context": _vote(cue & ~against, against & ~cue),
        "broken": (~loose & ~valid).cast("int"), "loose": loose.cast("int"), "cue": cue.cast("int"), "against": against.cast("int"), "edge": F.col("before").rlike(r"(^|[\s(:,;<\"'=])$").cast("int"),
        "size": F.least(F.floor(n / 8), F.lit(4)).cast("int"),
    })
    return each.select("k", "kind", "start", "end", "valid", *VOTES, *[c for c in FEATURES if c not in VOTES])


def reliabilities(patterns: list[tuple], rounds: int = 100) -> tuple[dict[int, float], list[dict[int, tuple[float, float]]], list[float]]:
    """Prior by form, per labeler {vote: (P given personal, P given other)}, and each pattern's posterior.

    ``patterns``: (votes, count). An abstaining labeler (vote 0) says nothing. Reliabilities are shared by
    the forms, which the rule's vote names (1 valid, -1 broken, 0 loose); each form has its own share of
    personal spans.
    """
    post = [min(0.95, max(0.05, 0.5 + sum(w * x for w, x in zip(FIRST, v)))) for v, _ in patterns]
    prior, tables = {}, []
    for _ in range(rounds):
        for form in {v[0] for v, _ in patterns}:
            own = [(p, c) for p, (v, c) in zip(post, patterns) if v[0] == form]
            prior[form] = (sum(p * c for p, c in own) + 1) / (sum(c for _, c in own) + 2)
        tables = [{1: RULE, -1: (1 - RULE[0], 1 - RULE[1])}]
        for k in range(1, len(VOTES)):
            weight = 1 + SHARE * sum(c for v, c in patterns if v[k])
            mass = {1: [weight * p for p in OTHERS], -1: [weight * (1 - p) for p in OTHERS]}
            for p, (v, c) in zip(post, patterns):
                if v[k]:
                    mass[v[k]][0] += p * c
                    mass[v[k]][1] += (1 - p) * c
            total = [mass[-1][side] + mass[1][side] for side in (0, 1)]
            tables.append({vote: (m[0] / total[0], m[1] / total[1]) for vote, m in mass.items()})
        new = []
        for v, _ in patterns:
            odds = math.log(prior[v[0]] / (1 - prior[v[0]])) + sum(math.log(t[x][0] / t[x][1]) for t, x in zip(tables, v) if x)
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if max((abs(a - b) for a, b in zip(new, post)), default=0) < 1e-6:
            break
        post = new
    return prior, tables, post


@dataclass
class Classifier:
    """Logistic weights per kind over a bias and ``FEATURES``."""

    weights: dict[int, list[float]] = field(default_factory=dict)

    def probability(self) -> Column:
        out = F.lit(0.0)
        for kind, w in self.weights.items():
            z = F.lit(w[0])
            for column, weight in zip(FEATURES, w[1:]):
                z = z + F.col(column).cast("double") * F.lit(weight)
            out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-z))).otherwise(out)
        return out


def fitted(rows: list[tuple], steps: int = 3000, rate: float = 0.5) -> list[float]:
    """Weights of one kind from (features, posterior, count); valid, broken and loose rows weigh the same."""
    totals: dict[tuple, int] = {}
    for x, _, c in rows:
        totals[x[:2]] = totals.get(x[:2], 0) + c
    data = [((1.0, *map(float, x)), y, c / totals[x[:2]] / len(totals)) for x, y, c in rows]
    w = [0.0] * (len(FEATURES) + 1)
    for _ in range(steps):
        grad = [0.0] * len(w)
        for x, y, c in data:
            off = c * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - y)
            for k, v in enumerate(x):
                grad[k] += off * v
        w = [a - rate * (g + 1e-4 * a * (k > 0)) for k, (a, g) in enumerate(zip(w, grad))]
    return w


def train(each: DataFrame) -> Classifier:
    """Estimates the labelers of each kind and fits its classifier on counts of feature patterns."""
    columns = list(dict.fromkeys(["kind", *FEATURES, *VOTES]))
    rows = each.groupBy(*columns).count().orderBy(*columns).collect()
    model = Classifier()
    for kind in range(len(KINDS)):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        seen = [tuple(r[c] for c in VOTES) for r in own]
        counts: dict[tuple, int] = {}
        for pattern, r in zip(seen, own):
            counts[pattern] = counts.get(pattern, 0) + r["count"]
        patterns = sorted(counts.items())
        target = {pattern: p for (pattern, _), p in zip(patterns, reliabilities(patterns)[2])}
        features: dict[tuple, list[float]] = {}
        for pattern, r in zip(seen, own):
            sums = features.setdefault(tuple(r[c] for c in FEATURES), [0.0, 0])
            sums[0] += target[pattern] * r["count"]
            sums[1] += r["count"]
        model.weights[kind] = fitted([(x, y / c, c) for x, (y, c) in sorted(features.items())])
    return model


def _text(list_: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(list_, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def accepted(found: DataFrame, *, accept: float = ACCEPT) -> DataFrame:
    """(k, base, all): sorted arrays of (kind, start, end) for each row that has any."""
    each = cut_lineage(spans(found))
    kept = each.where(F.col("valid") | (train(each).probability() >= accept))
    span = F.struct("kind", "start", "end")
    lists = kept.groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("valid"), span))).alias("base"), F.array_sort(F.collect_list(F.when(~F.col("valid"), span))).alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return lists.select("k", "base", F.array_sort(F.array_distinct(F.concat("base", free))).alias("all"))


def find(docs: DataFrame, *, text: str = "text", key: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """Per row: counts of base spans by kind, the hash of their list, and the list of all spans."""
    found = candidates(docs, text=text, key=key)
    out = found.select("id", "k").join(accepted(found, accept=accept), "k", "left")
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    out = out.select("id", F.coalesce("base", empty).alias("base"), F.coalesce("all", empty).alias("all"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(F.col("id").alias(key), *counts, F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.col("all")).alias("spans"))


def mask(docs: DataFrame, *, text: str = "text", key: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets."""
    found = candidates(docs, text=text, key=key)
    some = accepted(found, accept=accept)
    rows = docs.withColumn("k__", row_hash(key, text)).join(some.select(F.col("k").alias("k__"), F.col("all").alias("all__")), "k__", "left")
    # spans in order of place; one that begins inside an earlier one is cut by it
    by_place = F.array_sort(F.transform("all__", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    name = lambda s: F.element_at(F.array(*[F.lit(f"<{k}>") for k in KINDS]), s["kind"] + 1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), name(s)))).otherwise(acc["parts"]).alias("parts"),
    )
    masked = F.aggregate(by_place, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))
    return rows.withColumn(text, F.when(F.size("all__") > 0, masked).otherwise(F.col(text))).select(*docs.columns)
