"""Personal data by patterns and bootstrapped contexts, with DataFrame functions only.

Spans of four kinds are found by fixed patterns.  Those that stand as words of their own are seeds: each gives
lexical patterns, made of its shape (digits one by one, letters as runs), the word before and the word after.
Every other run of one to three words that has the form of some kind gives such patterns too, without a label.  Patterns and
instances (distinct strings) are a graph, over which Spark goes in rounds: a pattern's confidence in a kind is
the sum of its instances' confidences over their number (and one), an instance's is that of its best pattern.
What a pattern of high confidence matches, and what is a valid value of its kind, is a span found beyond the fixed ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, ref

KINDS = ("email", "ip", "card", "phone")
#: Rounds over the graph; least confidence and distinct seeds of a pattern that finds spans; least confidence that a pattern passes on.
ROUNDS, CONFIDENCE, SUPPORT, PASSED_ON = 3, 0.9, 5, 0.5
#: Tasks over which a pattern's rows are dealt.
SALTS = 16
#: Elements of an array that are summed at a time.
RUN = 256
#: Longest identifier of several words, in words and code points; code points of context.
WORDS, LONGEST, CONTEXT = 3, 64, 40

#: The kinds' patterns.  Each starts only where the plain pattern could start a match (``\\G``: where the
#: one before ended), and no repeated group backtracks, so that long runs take neither quadratic time nor stack.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole chain of digits with single separators, of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_GUARDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
}
_WORD = r"(?<!\S)(?=\S*[0-9@])\S++"

_HIT = "array<struct<s:int,e:int,t:string,before:string,after:string>>"
_SPAN = "array<struct<s:int,e:int,kind:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost matches that don't overlap, as structs: start, end, match, and the text's code points around it.

    Texts between matches are split off by the same pattern; their lengths give the places.
    """

    def placed(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        lengths = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.length(h) + F.length(g))

        def hit(ends: Column) -> Column:
            return F.transform(hits, lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("s"), F.get(ends, i).alias("e"), h.alias("t"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")))

        return F.when(F.size(hits) > 0, _let(running_sums(lengths), hit))

    pairs = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.coalesce(F.when(guard, _let(pairs, placed)), F.array().cast(_HIT))


def running_sums(lengths: Column) -> Column:
    """Inclusive sums of an array that isn't empty, in runs of ``RUN``: appending to one array would copy it for each element."""

    def summed(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"] + n).alias("out")), lambda acc: acc["out"])

    def joined_runs(own: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int")), lambda j: F.slice(own, j * RUN + 1, F.lit(RUN)))

        def offset(each: Column) -> Column:
            before = summed(F.transform(each, lambda r: F.aggregate(r, F.lit(0), lambda a, n: a + n)), F.lit(0))
            return _let(before, lambda sums: F.flatten(F.transform(each, lambda r, j: summed(r, F.coalesce(F.get(sums, j - 1), F.lit(0))))))

        return _let(runs, offset)

    return _let(lengths, joined_runs)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substr(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, t: Column) -> Column:
    """Whether a match is a value of its kind."""
    n = F.length(_digits(t))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda x: F.coalesce(x.try_cast("double") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(t))).otherwise(False)
    return n.between(10, 15)


#: A value that a pattern finds: as strict as a base value but for its form.
_FORMS = {
    "email": r"\A[^\s@]+@[^\s@]+\z",
    "ip": r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z",
    "card": r"\A[0-9](?:[ -]?[0-9]){13,18}\z",
    "phone": r"\A\+?[ ().0-9-]+\z",
}


def possible(t: Column) -> Column:
    """Whether a run of words has the form of some kind; all other runs are no instances."""
    return t.rlike(_FORMS["email"]) | t.rlike(_FORMS["ip"]) | (t.rlike(_FORMS["phone"]) & (F.length(_digits(t)) >= 7))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, in order of start, then of KINDS."""
    def of_kind(number: int, name: str) -> Column:
        good = F.filter(found(text, PATTERNS[name], _GUARDS[name](text)), lambda h: valid(name, h["t"]))
        return F.transform(good, lambda h: F.struct(h["s"].alias("s"), F.lit(number).alias("kind"), h["e"].alias("e")))

    in_order = F.array_sort(F.concat(*[of_kind(i, k) for i, k in enumerate(KINDS)]))
    return F.transform(in_order, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))


def _windows(words: Column) -> Column:
    """Runs of one to ``WORDS`` words with single spaces between, without the marks around them."""

    def starting(h: Column, i: Column) -> Column:
        out, whole, text, last = [], F.lit(True), h["t"], h
        for k in range(WORDS):
            if k:
                nxt = F.get(words, i + k)
                whole = whole & F.coalesce((nxt["s"] == last["e"] + 1) & (nxt["before"] == " "), F.lit(False))
                text, last = F.concat(text, F.lit(" "), nxt["t"]), nxt
            out.append(F.when(whole & (last["e"] - h["s"] <= LONGEST), F.struct(h["s"].alias("s"), last["e"].alias("e"), text.alias("t"), h["before"].alias("before"), last["after"].alias("after"))))
        return F.filter(F.array(*out), lambda w: w.isNotNull())

    def trimmed(w: Column) -> Column:
        lead = F.length(F.regexp_extract(w["t"], r"\A[^0-9A-Za-z+(]*", 0))
        core = F.regexp_extract(w["t"], r"(?s)\A[^0-9A-Za-z+(]*(.*?)[^0-9A-Za-z)]*\z", 1)
        return F.struct((w["s"] + lead).cast("int").alias("s"), (w["s"] + lead + F.length(core)).cast("int").alias("e"), core.alias("t"), w["before"].alias("before"), w["after"].alias("after"))

    return F.filter(F.transform(F.flatten(F.transform(words, starting)), trimmed), lambda w: possible(w["t"]))


def _mentions(windows: Column, base: Column) -> Column:
    """Windows with the kind of the base span that they are, and their patterns; those that cut into a base span are left out."""

    def mention(w: Column) -> Column:
        same = F.filter(base, lambda b: (b["s"] == w["s"]) & (b["e"] == w["e"]))
        shape = F.regexp_replace(F.regexp_replace(w["t"], "[0-9]", "9"), r"\p{L}+", "a")
        left = F.lower(F.regexp_extract(w["before"], r"(\p{L}{1,30})[^\p{L}0-9@]*\z", 1))
        right = F.lower(F.regexp_extract(w["after"], r"\A[^\p{L}0-9@]*(\p{L}{1,30})", 1))
        bar = F.lit("|")
        patterns = F.array(F.concat(F.lit("s|"), shape), F.concat(F.lit("l|"), shape, bar, left), F.concat(F.lit("r|"), shape, bar, right), F.concat(F.lit("c|"), left, bar, right, bar, F.regexp_replace(shape, "9+", "9")))
        return F.struct(w["s"].alias("s"), w["e"].alias("e"), w["t"].alias("t"), F.get(same, F.lit(0))["kind"].alias("kind"), patterns.alias("patterns"))

    outside = F.filter(windows, lambda w: F.forall(base, lambda b: (b["s"] >= w["e"]) | (b["e"] <= w["s"]) | ((b["s"] == w["s"]) & (b["e"] == w["e"]))))
    return F.transform(outside, mention)


def scanned(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """Documents -> (doc_id, base, mentions), without their texts."""
    out = docs.select(ref(doc_col).cast("long").alias("doc_id"), F.coalesce(ref(text_col).cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("base", base_spans(F.col("text")))
    out = out.withColumn("words", found(F.col("text"), _WORD, F.col("text").rlike("[0-9@]")))
    out = out.withColumn("windows", _windows(F.col("words"))).withColumn("mentions", _mentions(F.col("windows"), F.col("base")))
    # a generator between keeps later filters from being pushed into the searches
    return out.select("doc_id", F.inline(F.array(F.struct("base", "mentions"))))


def _by_pattern(rows: DataFrame, patterns: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """Rows joined with patterns, each pattern's rows dealt over ``SALTS`` tasks: a common shape may hold a third of all rows."""
    salted = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"], how).drop("salt")


def learned(mentions: DataFrame, scratch: Scratch) -> DataFrame:
    """(t, kind, patterns) of mentions, kind null where unlabelled -> (pattern, kind, confidence, support) after all rounds."""
    own = Scratch(mentions.sparkSession)  # goes when the patterns are written
    edges = own.keep(mentions.select("t", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "t").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind is not null").groupBy("t").agg(F.max("kind").alias("kind")).select("t", "kind", F.lit(1.0).alias("confidence"), F.lit(True).alias("seed"))
    # edges of patterns without a seed never count: patterns with one are found first
    promising = edges.where("kind is not null").select("pattern").distinct()
    edges = own.keep(_by_pattern(edges, promising, "t", "left_semi").select("pattern", "t"), "graph")
    instances = seeds = own.keep(seeds, "seeds")
    patterns = None
    for i in range(ROUNDS):
        of_kind = lambda what: [F.sum(F.when(F.col("kind") == k, what).otherwise(0.0)).alias(f"k{k}") for k in range(len(KINDS))]
        sums = edges.join(instances, "t", "left").groupBy("pattern").agg(F.count("*").alias("many"), *of_kind(F.col("confidence")), *[F.sum(F.when(F.col("seed") & (F.col("kind") == k), 1).otherwise(0)).alias(f"n{k}") for k in range(len(KINDS))])
        best = F.greatest(*[F.struct(F.col(f"k{k}").alias("sum"), F.lit(-k).alias("order"), F.lit(k).alias("kind"), F.col(f"n{k}").alias("support")) for k in range(len(KINDS))])
        patterns = sums.select("pattern", "many", best.alias("b")).select("pattern", F.col("b.kind").alias("kind"), (F.col("b.sum") / (F.col("many") + 1)).alias("confidence"), F.col("b.support").alias("support"))
        patterns = own.keep(patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= PASSED_ON)), f"patterns-{i}")
        if i + 1 < ROUNDS:
            reached = _by_pattern(edges, patterns, "t").groupBy("t").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("order"))).alias("b"))
            reached = reached.join(seeds, "t", "left_anti").select("t", (-F.col("b.order")).alias("kind"), F.col("b.confidence").alias("confidence"), F.lit(False).alias("seed"))
            instances = own.keep(seeds.unionByName(reached), f"instances-{i}")
    patterns = scratch.keep(patterns, "patterns")
    own.drop()
    return patterns


def find(docs: DataFrame, scratch: Scratch | None = None, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` -> (doc_id, base, added): arrays of spans (s, e, kind), in code points, by start.

    ``base`` are matches of the fixed patterns, ``kind`` their number in KINDS; ``added`` are spans that patterns of high confidence
    find beside them, never over a base span or each other (the earliest, then the longest stays).  Null and empty texts have none;
    rows are searched one by one, so that repeated rows have equal spans, while patterns come from distinct strings, so that
    copies of a document add nothing to a confidence; very long texts are searched whole; null ids stay null; other
    columns are ignored whatever their names; an empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    table = scratch.keep(scanned(docs, doc_col, text_col).withColumn("row", F.monotonically_increasing_id()), "scanned")
    mentions = table.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    accepted = learned(mentions, scratch).where(F.col("confidence") >= CONFIDENCE).select("pattern", F.col("kind").alias("found"), "confidence")
    open_ = mentions.where("kind is null").select("row", "s", "e", "t", F.explode("patterns").alias("pattern"))
    form = F.lit(False)
    for k, name in enumerate(KINDS):
        own = valid(name, F.col("t")) if name != "phone" else F.length(_digits(F.col("t"))).between(7, 15)
        form = F.when((F.col("found") == k) & F.col("t").rlike(_FORMS[name]), own).otherwise(form)
    hits = _by_pattern(open_, accepted, "row").where(form)
    hits = hits.groupBy("row", "s", "e").agg(F.max(F.struct("confidence", (-F.col("found")).alias("order"))).alias("b"))
    hits = hits.select("row", F.struct("s", (-F.col("e")).alias("back"), (-F.col("b.order")).alias("kind")).alias("x"))

    def apart(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) == 0) | (x["s"] >= F.get(acc, F.size(acc) - 1)["e"]), F.array_append(acc, F.struct(x["s"].alias("s"), (-x["back"]).cast("int").alias("e"), x["kind"].cast("int").alias("kind")))).otherwise(acc)

    more = hits.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("x")).select("row", F.aggregate("x", F.array().cast(_SPAN), apart).alias("added"))
    return table.select("row", "doc_id", "base").join(more, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined, by start, then in order of KINDS."""
    names = F.array(*[F.lit(k) for k in KINDS])
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    return F.array_join(F.transform(in_order, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
