"""Secret scans: fixed patterns, and a battery of randomness tests on what looks
like an encoded key.  DataFrame functions only.
"""

import math

from pyspark.sql import functions as F

from pairscreen.session import materialise

#: Kinds in their order; group 2 of ``assign`` is the value.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 6
#: Runs are taken whole, so a shorter run that fails hides no other match.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")

#: What the tests look at: whole runs of characters that encoded keys are made of.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+"

#: Encodings by name, in the order in which they are tried: pattern, alphabet.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[A-Za-z])([a-z0-9]+|[A-Z0-9]+)$", "0123456789" + _LOWER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", _UPPER + _LOWER + "0123456789"),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", _UPPER + _LOWER + "0123456789+/"),
)
#: Classes of length are powers of two; bins of the combined p-value are equal.
LENGTHS = 32
BINS = 20

#: Part of the steps of a text-like string that may be anything.
_ANYTHING = 0.2
#: A symbol seen so often counts half by what follows it, half by how common that is at
#: all: a key that lies in the background does not speak for itself.  Keys come with the
#: text, so in a large table it is this part of all steps.
SEEN = 1_000
SEEN_PART = 1 / 6_000
#: Neighbouring classes of length of an encoding are pooled up to so many runs.
POOLED = 200
#: Runs with a smaller combined p-value are no random strings, however unlike text.
ODD = 0.001
#: Scores are quarters of powers of ten, this many at most.
SCORES = 400
#: Part of the rate of false discoveries that scores may take.
SCORE_PART = 0.1

_SPANS = "array<struct<start:int,end:int,token:string>>"


def _bound(value, use):
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _running(values, combine, block=256):
    """What ``combine`` makes of all numbers before each one, from 0.  An array grows by
    copying, so blocks are run through by themselves and put behind each other: the
    work is in proportion to the numbers."""

    def scan(numbers, first):
        state = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            numbers,
            state,
            lambda a, v: F.struct(combine(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    zero = F.lit(0)
    starts = F.sequence(F.lit(1), F.size(values), F.lit(block))
    blocks = F.transform(starts, lambda i: F.slice(values, i, F.lit(block)))
    before = _bound(F.transform(blocks, lambda b: F.aggregate(b, zero, combine)), lambda t: scan(t, zero))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, before, scan))).otherwise(F.array().cast("array<int>"))


def _spans_between(gaps, found):
    """Where each of ``found`` lies: the matches and what stands between them add up
    to the text."""
    size = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, t: F.length(g) + F.length(t))
    starts = F.zip_with(_bound(size, lambda v: _running(v, lambda a, b: a + b)), gaps, lambda a, g: a + F.length(g))
    return F.zip_with(
        F.slice(starts, 1, F.size(found)),
        found,
        lambda a, t: F.struct(a.alias("start"), (a + F.length(t)).alias("end"), t.alias("token")),
    )


def _located(text, found, pattern):
    """Spans of ``found``, all matches of ``pattern`` in ``text``."""
    return F.when(F.size(found) > 0, _spans_between(F.split(text, pattern, -1), found)).otherwise(F.array().cast(_SPANS))


def _symbols(token, letters, alphabet):
    """A token as positions in its alphabet."""
    return F.transform(
        F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1
    )


def _encoded(c):
    """The first encoding that a token fits, as (number, alphabet size, symbols);
    null if it is in none, such as a plain word."""
    token = c["token"]
    out = F.lit(None)
    for i, (name, pattern, alphabet) in reversed(list(enumerate(ENCODINGS))):
        letters = F.lower(token) if name in ("hex", "base36") else F.translate(token, "-_", "+/")
        of = F.struct(
            F.lit(i).alias("number"),
            F.lit(float(len(alphabet))).alias("k"),
            _symbols(token, letters, alphabet).alias("x"),
        )
        out = F.when(token.rlike(pattern), of).otherwise(out)
    return out


def background(docs, text_col="text"):
    """How often each symbol follows each other one in all texts, each different text
    once: ``{(a, b): times}``.  Words are counted first, so a step is taken once for each
    different word.  At most a few thousand numbers reach the driver."""
    texts = docs.select(F.col(text_col).alias("t")).where("t IS NOT NULL").dropDuplicates(["t"])
    lines = texts.select(F.explode(F.split(F.translate("t", "-_", "+/"), r"[^A-Za-z0-9+/]+")).alias("w")).where("length(w) > 1")
    words = lines.groupBy("w").count()
    symbols = F.split("w", "(?!^)(?!$)")  # a place in a long word is found by counting from its start
    steps = F.zip_with(symbols, F.slice(symbols, 2, F.size(symbols)), lambda a, b: F.concat(a, b))
    pair = F.explode(F.filter(steps, lambda p: p.isNotNull())).alias("p")
    found = words.select(pair, "count").groupBy("p").agg(F.sum("count").alias("n")).collect()
    return {(r["p"][0], r["p"][1]): r["n"] for r in found}


def _step_table(follows):
    """For each encoding, alphabet by alphabet: log10 of how much likelier a symbol
    after another is in a random string than in text."""
    out, least = [], max(SEEN, SEEN_PART * sum(follows.values()))
    for name, _, alphabet in ENCODINGS:
        fold = str.lower if name in ("hex", "base36") else str
        held = {}
        for (a, b), n in follows.items():
            held[fold(a), fold(b)] = held.get((fold(a), fold(b)), 0) + n
        common = {b: 1 + sum(held.get((a, b), 0) for a in alphabet) for b in alphabet}
        whole = sum(common.values())
        for a in alphabet:
            total = sum(held.get((a, b), 0) for b in alphabet)
            for b in alphabet:
                seen = (held.get((a, b), 0) + least * common[b] / whole) / (total + least) * len(alphabet)
                out.append(-math.log10((1 - _ANYTHING) * seen + _ANYTHING))
    return out


_STEPS_AT = [sum(len(a) ** 2 for _, _, a in ENCODINGS[:i]) for i in range(len(ENCODINGS))]


def _unlike_text(e, table):
    """log10 of the likelihood of a run as a random string over that as text.  Its
    inverse is a p-value under text, as a ratio of likelihoods is above r with a chance
    of at most 1 / r there."""
    k = e["k"].cast("int")
    at = F.element_at(F.array(*[F.lit(n) for n in _STEPS_AT]), e["number"] + 1)
    first = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))

    def step(a, v):
        add = F.when(a["last"] < 0, 0.0).otherwise(F.element_at(table, (at + a["last"] * k + v + 1).cast("int")))
        return F.struct((a["sum"] + add).alias("sum"), v.alias("last"))

    return F.aggregate(e["x"], first, step, lambda a: a["sum"])


def _upper_tail(s):
    """P(chi-squared with 3 degrees of freedom > s); the error function by the
    usual five-term polynomial."""
    x = F.sqrt(s / 2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-s / 2) + F.sqrt(2 * s / 3.141592653589793) * F.exp(-s / 2)


def _sums(e):
    """One pass over a run: what the tests need of it."""
    middle = e["k"] / 2
    names = ("sum", "squares", "lag", "high", "changes", "last", "first")
    start = F.struct(*[F.lit(-1.0 if c in ("last", "first") else 0.0).alias(c) for c in names])

    def step(a, v):
        v = v.cast("double")
        later = a["last"] >= 0
        change = later & ((a["last"] >= middle) != (v >= middle))
        new = (
            a["sum"] + v,
            a["squares"] + v * v,
            a["lag"] + F.when(later, a["last"] * v).otherwise(0.0),
            a["high"] + F.when(v >= middle, 1.0).otherwise(0.0),
            a["changes"] + F.when(change, 1.0).otherwise(0.0),
            v,
            F.when(later, a["first"]).otherwise(v),
        )
        return F.struct(*[x.alias(c) for x, c in zip(new, names)])

    return F.aggregate(e["x"], start, step)


def _scores(e, m):
    """Normal scores of the three tests: chi-squared of the alphabet (by its cube root),
    runs above and below the middle of it, lag-one correlation.  Symbols are whole
    numbers, so the sums lose nothing."""
    x, k = e["x"], e["k"]
    n = F.size(x).cast("double")
    far = F.lit(8.0)
    counted = F.aggregate(
        F.sequence(F.lit(0), k.cast("int") - 1),
        F.lit(0.0),
        lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)),
    )
    spread = 2 / (9 * (k - 1))
    uniform = (F.pow((k / n * counted - n) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    mean_runs = 2 * m["high"] * (n - m["high"]) / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    runs = F.when(var_runs > 0, (1 + m["changes"] - mean_runs) / F.sqrt(var_runs)).otherwise(far)
    mean = m["sum"] / n
    var = m["squares"] - m["sum"] * mean
    lag = m["lag"] - mean * (2 * m["sum"] - m["first"] - m["last"]) + (n - 1) * mean * mean
    serial = F.when(var > 0, (lag / var + 1 / n) * F.sqrt(n)).otherwise(far)
    return F.struct(uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"))


def _battery(e):
    """Combined p-value of a random string: the squares of three normal scores add up to
    chi-squared with 3 degrees of freedom."""
    square = lambda s: s["uniform"] * s["uniform"] + s["runs"] * s["runs"] + s["serial"] * s["serial"]
    return _bound(_bound(_bound(_sums(e), lambda m: _scores(e, m)), square), _upper_tail)


def scan(docs, follows, text_col="text"):
    """``docs`` with ``base`` (spans of the fixed patterns, by start and kind) and
    ``tested`` (runs that none of them touches, in a known encoding, with their class,
    p-value bin and score).  ``follows`` is the ``background``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    taken = docs.withColumns(
        {
            "assigned": F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)),
            "access": F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
            "hexes": F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
        }
    )
    taken = taken.withColumn("assigned", _located(text, F.col("assigned"), ASSIGN))
    # A match of ``assign`` ends a run; one of the others lies in a run.
    rest = F.when(F.size("assigned") > 0, F.split(text, ASSIGN, -1)).otherwise(F.array(text))
    behind = F.concat(F.array(F.lit(0)), F.transform("assigned", lambda s: s["end"]))
    within = F.zip_with(
        rest,
        behind,
        lambda part, at: F.transform(
            _located(part, F.regexp_extract_all(part, F.lit(CANDIDATE), F.lit(0)), CANDIDATE),
            lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["token"].alias("token")),
        ),
    )
    taken = taken.withColumn("runs", F.when(text.rlike(CANDIDATE), F.flatten(within)).otherwise(F.array().cast(_SPANS)))

    def kind(spans, rank):
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end")),
        )

    value = F.when(F.size("assigned") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    long = F.zip_with(
        "assigned",
        F.coalesce(value, F.array().cast("array<string>")),
        lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(v).alias("n")),
    )
    base = F.array_sort(
        F.concat(
            kind(F.filter(long, lambda s: s["n"] >= ASSIGN_VALUE), 0),
            kind(_located(text, F.col("access"), ACCESS), 1),
            kind(_located(text, F.col("hexes"), HEX), 2),
        )
    )
    encoded = F.filter(
        F.transform(
            F.filter("runs", lambda c: ~c["token"].rlike(HEX) & ~c["token"].rlike(ACCESS)),
            lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _encoded(c).alias("e")),
        ),
        lambda c: c["e"].isNotNull(),
    )
    placed = taken.withColumns({"base": base, "encoded": encoded})
    table = F.split(F.lit(",".join(f"{x:.3f}" for x in _step_table(follows))), ",").cast("array<double>")
    tested = F.transform(
        "encoded",
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            (c["e"]["number"] * LENGTHS + F.floor(F.log2(F.size(c["e"]["x"]).cast("double"))).cast("int")).alias("stratum"),
            _battery(c["e"]).alias("p"),
            F.floor(_unlike_text(c["e"], table) * 4).cast("int").alias("score"),
        ),
    )
    binned = F.transform(
        tested,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            c["stratum"].alias("stratum"),
            F.least(F.greatest(F.floor(c["p"] * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1)).alias("bin"),
            F.when(c["p"] >= ODD, F.least(F.greatest(c["score"], F.lit(0)), F.lit(SCORES))).otherwise(0).alias("score"),
        ),
    )
    return placed.withColumn("tested", binned).drop("assigned", "access", "hexes", "runs", "encoded")


def _counts(scanned):
    """Runs by class, bin and score: a fixed number of rows at most reaches the
    driver."""
    return (
        scanned.select(F.explode("tested").alias("c"))
        .groupBy(F.col("c.stratum").alias("stratum"), F.col("c.bin").alias("bin"), F.col("c.score").alias("score"))
        .count()
        .collect()
    )


def pools(counts, least=POOLED):
    """Classes that are judged together, as lists of strata: those of one encoding,
    from the shortest runs on, until they hold ``least`` runs; what is left over at the
    end joins the pool before it."""
    size = {}
    for row in counts:
        size[row["stratum"]] = size.get(row["stratum"], 0) + row["count"]
    out = []
    for number in range(len(ENCODINGS)):
        own, held = [], 0
        for stratum in sorted(x for x in size if x // LENGTHS == number):
            if not own or held >= least:
                own.append([])
                held = 0
            own[-1].append(stratum)
            held += size[stratum]
        if len(own) > 1 and held < least:
            short = own.pop()
            own[-1] += short
        out += own
    return out


def least_bin(bins, rate):
    """The least p-value bin that counts as random in a pool; BINS if none does.

    P-values of random strings are even; those of text pile up near zero.  So the
    upper half of the bins shows how many random strings there are, and what lies
    above a bin beyond their share is text called by mistake.  One more is added
    to it, so a pool with little evidence calls nothing by its bins.
    """
    even = sum(bins[BINS // 2 :]) / (BINS - BINS // 2)
    for b in range(BINS):
        called = sum(bins[b:])
        wrong = max(0.0, called - even * (BINS - b)) + 1
        if called and wrong <= rate * called:
            return b
    return BINS


def least_score(scores, rate):
    """The least score that counts as random in a pool: of its runs, were they text, at
    most ``rate`` of those called would reach it (Benjamini-Hochberg).  A single run can
    be called if it is clear enough; long runs do not pay for the many short ones."""
    for s in range(1, SCORES + 1):
        called = sum(scores[s:])
        if called and sum(scores) * 10 ** (-s / 4) <= rate * called:
            return s
    return SCORES + 1


def thresholds(counts, rate):
    """The least bin and the least score that are called, for every stratum."""
    bins, scores = [BINS] * (len(ENCODINGS) * LENGTHS), [SCORES + 1] * (len(ENCODINGS) * LENGTHS)
    for pool in pools(counts):
        by_bin, by_score = [0] * BINS, [0] * (SCORES + 1)
        for row in counts:
            if row["stratum"] in pool:
                by_bin[row["bin"]] += row["count"]
                by_score[row["score"]] += row["count"]
        for stratum in pool:
            bins[stratum] = least_bin(by_bin, rate * (1 - SCORE_PART))
            scores[stratum] = least_score(by_score, rate * SCORE_PART)
    return bins, scores


def _with_random(scanned, rate):
    """``scanned`` with ``spans``: the base ones and the runs that the bins or the scores
    of their pool call random.  The two share the rate."""
    bins, scores = (F.array(*[F.lit(x) for x in xs]) for xs in thresholds(_counts(scanned), rate))
    called = F.filter(
        "tested",
        lambda c: (c["bin"] >= F.element_at(bins, c["stratum"] + 1)) | (c["score"] >= F.element_at(scores, c["stratum"] + 1)),
    )
    random = F.transform(called, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", random)))


def find_secrets(docs, keep=("doc_id",), text_col="text", rate=0.1):
    """Spans of secrets in whole texts: the columns of ``keep`` with ``base`` and
    ``spans``, arrays of (start, kind, end) in code points, end exclusive; kind is a
    position in ``KINDS``.

    Fixed patterns give the base spans.  ``random`` spans are runs of 20 characters
    or more, apart from these, in an inferred encoding that pass the randomness tests, at
    a rate of false discoveries of at most ``rate`` in each encoding and class of length
    (small classes are pooled with their neighbours): by how even the p-values are, or
    by how unlike text a run is, so that a single clear run is found in any table.  What
    text is like is counted over all texts.  What is found is written, counted, and read again.

    A null or empty text has no spans.  Nulls in other columns are kept, repeated
    rows each come back, an empty table gives no rows, other columns are ignored.  The
    work is in proportion to the text, however long a run is or many there are.
    """
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))
    found = scan(rows, background(rows, "text")).drop("text")
    marked = _with_random(materialise(found, "secrets"), rate)
    return marked.select(*[F.col("row")[c].alias(c) for c in keep], "base", "spans")


def spans_text(spans):
    """Spans as kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def _without(text, spans, mark, block=256):
    """``text`` with ``mark`` for each stretch that overlapping ``spans`` cover.  Spans are
    taken in blocks, so that no part of the text is looked at more than a few hundred
    times, however many there are."""
    ends = F.transform(spans, lambda s: s["end"])
    before = _bound(ends, lambda v: _running(v, lambda a, b: F.greatest(a, b)))
    gaps = F.filter(
        F.zip_with(spans, before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"))),
        lambda g: (g["start"] > g["at"]) | ((g["start"] == 0) & (g["at"] == 0)),
    )

    def cut(gaps):
        starts = F.sequence(F.lit(1), F.size(gaps), F.lit(block))

        def part(i):
            def pieces(some):
                low = some[0]["at"]
                whole = F.substring(text, low + 1, F.element_at(some, -1)["start"] - low)
                return _bound(
                    whole,
                    lambda t: F.array_join(
                        F.transform(some, lambda g: F.concat(F.substring(t, g["at"] - low + 1, g["start"] - g["at"]), F.lit(mark))), ""
                    ),
                )

            return _bound(F.slice(gaps, i, F.lit(block)), pieces)

        return F.array_join(F.transform(starts, part), "")

    return F.concat(_bound(gaps, cut), F.substring(text, F.array_max(ends) + 1, F.length(text)))


def redact(docs, text_col="text", mark="[SECRET]", rate=0.1, length_col=None):
    """``docs`` with every secret span of ``text_col`` replaced by ``mark``;
    overlapping spans become one mark, and ``length_col``, if named, is set to the new
    length.  Rows without spans stay as they are, and so do all other columns, whatever
    their names."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = docs.select(row, docs[f"`{text_col}`"].alias("text"))
    found = scan(rows, background(rows, "text")).drop("text")
    found = _with_random(materialise(found, "secrets"), rate)
    text = F.col("row")[text_col]
    found = found.withColumn("text", F.when(F.size("spans") > 0, _without(text, F.col("spans"), mark)).otherwise(text))
    new = {text_col: F.col("text")}
    if length_col:
        length = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("row")[length_col])
        new[length_col] = length.cast(dict(docs.dtypes)[length_col])
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
