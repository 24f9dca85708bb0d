"""Personal data by weak supervision.

Candidate spans are found in every whole text: the base kinds by strict
patterns, further kinds by loose ones. Six labelers (format, gazetteer, words
before, words that speak against it, boundaries, repetition) vote on each
candidate: 1 personal, -1 not, 0 abstains. Expectation-maximisation over the
counts of vote patterns estimates, for each kind of its own, how reliable each
labeler is; its posteriors train the span classifier, which reads the votes, the
length and letters of the span and what stands before it, and decides about the
loose candidates. Base spans always stay.

A match is itself a vote for its kind: the first belief is one more than the sum
of the votes. No labeler counts against what it votes for, an abstaining one says
nothing, and half of the share of personal spans of a kind stays that of the first
belief; so candidates that look all the same are kept by their votes, however
many there are of them or of other kinds.

All of it is DataFrame functions. Positions come from the lengths of matches
and of the pieces between them; texts aren't moved: a pass over them writes
candidates with their votes as small numbers, and everything after reads that.
"""

import math

from pyspark.sql import functions as F

from mailspark.llm.common import table, whole_text
from mailspark.session import written

#: Kinds in order; the first four are the base kinds. Patterns for Java; each
#: needs a character of the guard to be worth a search. Runs are matched
#: without giving back and entered at their start only (or where the last
#: match ended), so that long runs cost linear time; matches are the same.
KINDS = ("email", "ip", "card", "phone", "alias", "local_phone", "id_number", "person", "secret")
BASE = KINDS[:4]
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("[0-9]\\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": ("[0-9][\\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("\\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "alias": ("(?i)[(\\[{\\x20](?:at|dot)[)\\]}\\x20]",
              r"(?i)(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?"
              r"[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z]{2,}+)+"),
    "local_phone": ("[0-9][).\\x20-]", r"(?<![0-9A-Za-z+(.-])(?<!\+[0-9]{1,3}\x20)(?:\([0-9]{2,5}\)\x20?|[0-9]{3,5}[\x20.-])"
                    r"[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[\x20.-][0-9])"),
    "id_number": ("[0-9]-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
    "person": ("(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme|Mlle)\\b",
               r"(?<![\p{L}0-9])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Sra?|Mme|Mlle)\.?\x20"
               r"\p{Lu}[\p{L}'-]++(?:\x20\p{Lu}[\p{L}'-]++)*+"),
    "secret": ("(?i)(?:token|passw|secret|key)", r"(?i)(?<![A-Za-z0-9])(?:api[_\x20-]?key|access[_\x20-]?key|auth[_\x20-]?"
               r"token|token|password|passwd|secret)\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9+/_.~-]{8,}+"),
}

#: Gazetteers and context words.
DOMAINS = ("com org net edu gov int info biz io de fr es it uk eu ch at nl be pl se no dk fi pt ru cn jp "
           "in br au ca us mx ar").split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 " \
                "63 64 65 66 81 82 84 86 90 91 92 98 212 234 351 352 353 358 380 420 972".split()
FOR_WORDS = ("call phone tel telephone mobile fax mail email e-mail contact write reach card visa credit "
             "ip address addr host login user name born ssn id passport token password secret key "
             "anruf telefon kontakt adresse appel courriel telefono correo").split()
AGAINST_WORDS = ("version v ver isbn page p chapter section figure fig table total price usd eur order "
                 "item sku model serial part lot rev release build about approximately").split()

LABELERS = 6
LENGTHS = (8, 12, 16, 24)
ROUNDS = 12

#: Features of a candidate and their sizes, as its code holds them, the first
#: one in the lowest place: the votes; the length; digits only, letters of one
#: case, of both, or letters and digits; before it nothing, a word, a mark or else.
VOTES = {f"v{i}": 3 for i in range(LABELERS)}
FEATURES = {**VOTES, "length": len(LENGTHS) + 1, "letters": 4, "lead": 4}
PLACES = {f: math.prod(list(FEATURES.values())[:i]) for i, f in enumerate(FEATURES)}
PLACES["kind"] = math.prod(FEATURES.values())


def _digits(c):
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind, m):
    """What a match of a base kind must fulfil besides its pattern."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
            "^(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.char_length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(8, 15)
    return F.lit(True)


def _vote(yes, no):
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _words(words):
    return r"(?i)(?<![\p{L}0-9])(?:" + "|".join(words) + r")[\x20.:=#\"'(-]*$"


def _votes(kind, m, before, after):
    """Votes plus one (0, 1, 2) of the labelers on a candidate."""
    never, n = F.lit(False), F.char_length(_digits(m))
    fmt = {
        "email": (m.rlike(r"\.[A-Za-z]{2,24}$"), ~m.rlike(r"\.[A-Za-z]{2,24}$")),
        "ip": (m.rlike(r"^(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), m.rlike(r"^0+\.")),
        "card": (m.rlike("^[23456]"), m.rlike("^[01789]")),
        "phone": (n.between(10, 13), n < 9),
        "alias": (m.rlike(r"(?i)[(\[{]at"), m.rlike(r"(?i)[.,]\x20at\x20")),
        "local_phone": (n.between(10, 11), n < 9),
        "id_number": (~m.rlike("^(?:000|666|9)|-00-|-0000$"), m.rlike("^(?:000|666|9)|-00-|-0000$")),
        "person": (m.rlike(r"\x20\p{Lu}[\p{L}'-]+\x20\p{Lu}"), m.rlike(r"\p{Lu}{4,}")),
        "secret": (m.rlike(r"[=:][^=:]*[0-9]") & m.rlike(r"[=:][^=:]*[A-Za-z]") & (F.char_length(m) >= 24),
                   m.rlike(r"(?i)[=:]\x20*[\"']?[a-z.]+$")),
    }[kind]
    tld = F.lower(F.regexp_extract(m, r"(?<![A-Za-z])([A-Za-z]++)$", 1))
    gazetteer = {
        "email": (tld.isin(DOMAINS), never),
        "alias": (tld.isin(DOMAINS), ~tld.isin(DOMAINS)),
        "phone": (m.rlike(r"^\+(?:" + "|".join(COUNTRY_CODES) + ")"), never),
        "local_phone": (m.startswith("("), m.rlike(r"^[01]{3}")),
        "ip": (never, m.rlike(r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")),
        "card": (m.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), never),
        "id_number": (never, never),
        "person": (m.rlike(r"^(?:Mrs?|Ms|Dr|Prof|Mme|Mlle)\."), never),
        "secret": (m.rlike(r"(?i)^(?:api|access|auth|passw)"), never),
    }[kind]
    context = (before.rlike(_words(FOR_WORDS)), never)
    against = (never, before.rlike(_words(AGAINST_WORDS)))
    edge = before.rlike(r"[\p{L}0-9_]$") | after.rlike(r"^[\p{L}0-9_]")
    repeat = m.rlike(r"([0-9])\1{6}|(?:0123456|1234567)|(?i)(?:x{4}|test|changeme|example\x20at)")
    return [_vote(*fmt), _vote(*gazetteer), _vote(*context), _vote(*against), _vote(~edge, edge),
            _vote(never, repeat)]


def _code(kind, m, before, after):
    """Kind and features of a candidate as one number."""
    n = F.char_length(m)
    parts = dict(zip(VOTES, _votes(kind, m, before, after)))
    parts["length"] = sum(((n >= edge).cast("int") for edge in LENGTHS), F.lit(0))
    parts["letters"] = (F.when(~m.rlike(r"\p{L}"), 0).when(m.rlike("[0-9]"), 3)
                        .when(m.rlike(r"\p{Ll}") & m.rlike(r"\p{Lu}"), 2).otherwise(1))
    parts["lead"] = (F.when(before.rlike(r"(?:^|\n)[\x20\t]*$"), 0).when(before.rlike(r"[\p{L}0-9]\x20?$"), 1)
                     .when(before.rlike(r"[:=,;.!?(\[{<\"'-]\x20?$"), 2).otherwise(3))
    code = F.lit(KINDS.index(kind) * PLACES["kind"])
    for f, part in parts.items():
        code = code + part * PLACES[f]
    return code.cast("int")


def _added(array):
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def _run(k):
    return F.ceil(F.sqrt(F.size(f"__s_{k}"))).cast("int")


def _steps(k):
    """From the end of a match to the end of the next."""
    gaps = F.col(f"__g_{k}")
    return F.when(gaps.isNotNull(), F.transform(f"__m_{k}", lambda m, i: (
        F.char_length(m) + F.char_length(F.get(gaps, i))).cast("long"))).alias(f"__s_{k}")


def _run_sums(k):
    steps, run = F.col(f"__s_{k}"), _run(k)
    last = F.floor((F.size(steps) - 1) / run).cast("int")
    return F.when(steps.isNotNull(), F.transform(
        F.sequence(F.lit(0), last), lambda b: _added(F.slice(steps, b * run + 1, run)))).alias(f"__r_{k}")


def _run_starts(k):
    sums = F.col(f"__r_{k}")
    return F.when(sums.isNotNull(), F.transform(
        F.sequence(F.lit(0), F.size(sums) - 1), lambda b: _added(F.slice(sums, F.lit(1), b)))).alias(f"__p_{k}")


def _placed(k):
    """Matches with their start and what stands before and after."""
    gaps, steps, starts, run = F.col(f"__g_{k}"), F.col(f"__s_{k}"), F.col(f"__p_{k}"), _run(k)

    def place(m, i):
        b = F.floor(i / run).cast("int")
        inside = _added(F.slice(steps, b * run + 1, i - b * run))
        return F.struct(
            m.alias("m"), (F.get(starts, b) + inside + F.char_length(F.get(gaps, i))).alias("start"),
            F.right(F.get(gaps, i), F.lit(32)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))

    return F.when(starts.isNotNull(), F.transform(f"__m_{k}", place)).alias(f"__c_{k}")


def _numbered(k):
    """Spans of a kind with their code, failing matches dropped."""
    found = F.col(f"__c_{k}")
    if k in BASE:
        found = F.filter(found, lambda s: _valid(k, s["m"]))
    return F.coalesce(F.transform(found, lambda s: F.struct(
        F.lit(KINDS.index(k)).alias("kind"), s["start"].alias("start"),
        (s["start"] + F.char_length(s["m"])).alias("end"),
        _code(k, s["m"], s["before"], s["after"]).alias("code"))),
        F.array().cast("array<struct<kind:int,start:bigint,end:bigint,code:int>>"))


def candidates(df, id_column="doc_id", text="text"):
    """Id, and ``spans``: array of (kind, start, end, code) of each whole
    text, by kind in order, then start; code points, end exclusive. Null and
    empty texts have no spans."""
    keep = [id_column]
    out = df.select(*[F.col(f"`{c}`") for c in keep], whole_text(df, text).alias("__text"))
    found, split = {}, {}
    for k, (guard, pattern) in PATTERNS.items():
        worth = F.col("__text").rlike(guard)
        found[f"__m_{k}"] = F.when(worth, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
        split[f"__g_{k}"] = F.when(F.size(f"__m_{k}") > 0, F.split("__text", pattern, -1))
    out = out.select(*keep, "__text", *[c.alias(n) for n, c in found.items()])
    out = out.select(*keep, *found, *[c.alias(n) for n, c in split.items()])
    # Where a piece ends: sums over runs of about sqrt(n) steps, so that a text
    # with n matches costs n sqrt(n).
    for make in (_steps, _run_sums, _run_starts):
        out = out.select("*", *[make(k) for k in KINDS])
    out = out.select(*keep, *[_placed(k) for k in KINDS])
    kinds = [_numbered(k) for k in KINDS]
    return out.select(*keep, F.concat(*kinds).alias("spans"))


def _part(code, feature):
    """The value of a feature, or the kind, in a code."""
    value = F.floor(code / PLACES[feature]).cast("int")
    return value % FEATURES[feature] if feature in FEATURES else value


def _patterns(spans):
    """Counts by code, with its parts: as many rows at most as there are codes,
    whatever the data."""
    counts = spans.select(F.explode("spans").alias("s")).groupBy(F.col("s.code").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))
    return written(counts.select("n", *[_part(F.col("code"), f).alias(f) for f in PLACES]), "vote-patterns")


def _first_belief():
    """The match is a vote, and each labeler has one."""
    return 1 / (1 + F.exp(-sum((F.col(v) - 1 for v in VOTES), F.lit(1)).cast("double")))


def _fitted(patterns, posterior, features):
    """Per kind, the log odds of the prior and per value of each feature, from
    posteriors: one aggregate over the patterns; counts are smoothed by one."""
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]))
    rows = patterns.select("kind", "n", posterior.alias("p"), _first_belief().alias("first"), values.alias("f"))
    found, zero = {}, dict.fromkeys(("on", "off", "first", "n"), 0.0)
    for r in rows.groupBy("kind", "f.feature", "f.value").agg(
            F.sum(F.col("n") * F.col("p")).alias("on"), F.sum(F.col("n") * (1 - F.col("p"))).alias("off"),
            F.sum(F.col("n") * F.col("first")).alias("first"), F.sum("n").alias("n")).collect():
        found.setdefault(r["kind"], {})[r["feature"], r["value"]] = r
    # Each candidate has one value of a feature: any feature gives the totals.
    # Rounded, so that the order of sums doesn't show.
    totals = {kind: {c: round(sum(r[c] for (f, _), r in parts.items() if f == "v0"), 6) for c in zero}
              for kind, parts in found.items()}

    def odds(on, off, all_on=0.0, all_off=0.0):
        return round(math.log((on + 1) / (all_on + 1)) - math.log((off + 1) / (all_off + 1)), 9)

    def weight(kind, f, v):
        r = found[kind].get((f, v), zero)
        w = odds(r["on"], r["off"], totals[kind]["on"], totals[kind]["off"])
        return w if f not in VOTES else (min(w, 0.0), 0.0, max(w, 0.0))[v]

    return {kind: (odds(t["on"] + t["first"], t["off"] + t["n"] - t["first"]),
                   {f: [weight(kind, f, v) for v in range(FEATURES[f])] for f in features})
            for kind, t in totals.items()}


def _logit(model, part):
    """Log odds of a candidate, whose kind and features ``part`` gives."""
    def of(values, place):
        return F.get(F.expr("array(" + ",".join(f"{float(x)!r}D" for x in values) + ")"), place)

    none = (0.0, {f: [0.0] * size for f, size in FEATURES.items()})
    kinds = [model.get(k, none) for k in range(len(KINDS))]
    total = of([prior for prior, _ in kinds], part("kind"))
    for f in next(iter(model.values()), none)[1]:
        total = total + of([x for _, weights in kinds for x in weights[f]], part("kind") * FEATURES[f] + part(f))
    return total


def trained(spans, rounds=ROUNDS):
    """By kind, (prior, weights by feature) of the span classifier, trained on
    the posteriors of expectation-maximisation over the labelers' votes."""
    patterns = _patterns(spans)
    posterior = _first_belief()
    for _ in range(rounds):
        posterior = 1 / (1 + F.exp(-_logit(_fitted(patterns, posterior, VOTES), F.col)))
    return _fitted(patterns, posterior, FEATURES)


def decided(spans, classifier, id_column="doc_id"):
    """The spans that stay: all base ones, and those that the classifier takes
    for personal data."""
    return spans.select(F.col(f"`{id_column}`"), F.filter("spans", lambda s: (s["kind"] < len(BASE)) | (
        _logit(classifier, lambda f: _part(s["code"], f)) > 0)).alias("spans"))


def find(df, id_column="doc_id", text="text"):
    """(id, spans) of each row: array of (kind number, start, end, code). Rows
    come as often as they are given; null ids stay null."""
    spans = written(candidates(df, id_column, text), "spans")
    return decided(spans, trained(spans), id_column)


def op1_weak_supervision_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}")
              for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
