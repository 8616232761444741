"""Operator 5: secret scans with a random forest that removes false positives, in DataFrame operations alone.

A finding is a run of 16 or more characters of keys and tokens with a digit in it, alone or as the value of an
assignment (``name=value``, ``name: "value"``), each of several in a word by itself; or any other value
that a name of credentials is given, quoted or up to a blank or separator, however short; or a user's password in a
URL; or a private key from its first line to its last. Features of a finding: its length, how often each
transition between lower case, upper case, digits and signs comes in it, how many different characters and digits it has, how much
of it are dictionary words (the commonest words of the corpus, counted over all documents), and, hashed, the
words around it and the document's path (``source``).

The forest is trained from labelled findings. Where none are given they are labelled from a distance: a finding
in a provider's fixed format, a private key, or what is assigned to a name of credentials (four characters or more) is a
secret; any other is not, nor is a plain word after a name, colon and blank, as in prose. The name itself is no feature. At most
about ``sample`` of them, spread by a hash, are learned from. If they are not of both kinds there is no forest
and the labels stand. Null and empty texts have no findings; each row of a repeated doc_id is scanned by itself.
A missing ``source`` counts as empty. Only the columns named here are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import durable, trim_driver

RUN = r"[A-Za-z0-9+/_.\-]{16,}"
#: Names that credentials are assigned to, and formats that providers give theirs.
NAMES = "api_?key|apikey|access_?key|auth|credential|passw(?:or)?d|private_?key|pwd|secret|token"
FORMATS = r"^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|-----BEGIN [\s\S]*)$"
_KEY = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
PRIVATE = rf"-----BEGIN {_KEY}(?:[\s\S]*?-----END {_KEY}|[A-Za-z0-9+/=\s]*)"
IN_URL = r"""://[^\s/:@"'<>]*:[^\s/@"'<>]+@"""
#: A name of credentials and what it is given: in double quotes, in single ones, or bare.
GIVEN = rf"""(?i)(?<![A-Za-z])({NAMES.replace("_?", "[_-]?")})["']?\s{{0,3}}(?:=>|[=:]{{1,2}})\s{{0,3}}(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"'&,;<>(){{}}\[\]]+))"""
MASK = "[SECRET]"
#: Characters beside a finding that its name and the words around it are read from.
NEAR = 80
WORDS = ("before2", "before1", "after1", "path")
#: Classes of characters in the shape of a finding: lower case, upper case, digits, signs.
CLASSES = "aA0-"
TRANSITIONS = {f"from{i}to{j}": CLASSES[i] + CLASSES[j] for i in range(4) for j in range(4) if i != j}
NUMBERS = ("length", "kinds", "digits", "upper", "signs", "coverage", *TRANSITIONS)
#: Every name of credentials has one of these in it: a cheap look before the pattern's.
STEMS = ("key", "auth", "credential", "passw", "pwd", "secret", "token")


def dictionary(docs: DataFrame, size: int = 20_000) -> DataFrame:
    """The ``size`` commonest words of three to twelve letters, counted over all documents."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(3, 12))
    return words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).select("word")


def _spots(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """A row per match of ``pattern`` in column ``text``: ``m``, and ``at``, the characters before it."""
    both = rows.withColumns({"_m": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "_p": F.split(text, pattern, -1)})
    long = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x))
    both = both.select("*", F.posexplode("_m").alias("_j", "m"))
    return both.withColumn("at", long(F.slice("_p", 1, F.col("_j") + 1)) + long(F.slice("_m", 1, F.col("_j")))).drop("_m", "_p", "_j")


def _runs(docs: DataFrame) -> DataFrame:
    some = docs.where(F.col("text").rlike(RUN))
    words = some.select("doc_id", "path", F.split("text", r"\s").alias("_w"))
    near = lambda i, k: F.coalesce(F.get("_w", i + k), F.lit(""))
    hits = F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: s["w"].rlike(RUN) & s["w"].rlike("[0-9]"))
    rows = words.select("doc_id", "path", "_w", F.explode(hits).alias("h")).select("doc_id", "path", "h.i", "h.w", *[near(F.col("h.i"), k).alias(n) for n, k in (("w2", -2), ("w1", -1), ("w3", 1))], F.when(F.col("h.i") > 0, F.length(F.array_join(F.slice("_w", 1, F.col("h.i")), " ")) + 1).otherwise(0).alias("lead"))
    rows = _spots(rows, "w", RUN).withColumn("value", F.rtrim("m", F.lit("."))).where(F.length("value") >= 16).where(F.col("value").rlike("[0-9]"))
    rows = rows.withColumn("pre", F.expr(f"substring(w, greatest(at - {NEAR}, 0) + 1, least(at, {NEAR}))")).withColumn("post", F.expr(f"substring(w, at + length(m) + 1, {NEAR})"))
    own = F.regexp_extract("pre", r"([A-Za-z][A-Za-z_\-]{1,29})[\"']?[=:]+[^A-Za-z0-9=:]*$", 1)
    alone = ~F.col("pre").rlike("[A-Za-z0-9]")
    in_url = F.col("pre").rlike(r"://[^\s/:@]*:$") & F.startswith("post", F.lit("@"))
    name = F.when(in_url, "password").when(own != "", own).when(alone & F.col("w1").rlike(r"^[=:]+$"), F.col("w2")).when(alone & F.col("w1").rlike("[=:]$"), F.col("w1")).otherwise("")
    parts = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    before = F.concat(F.array("w2", "w1"), parts(F.col("pre")))
    after = F.concat(parts(F.col("post")), F.array("w3"))
    return rows.select("doc_id", (F.col("lead") + F.col("at")).alias("start"), "value", F.element_at(before, -2).alias("before2"), F.element_at(before, -1).alias("before1"), after[0].alias("after1"), name.alias("name"), "path")


def _given(docs: DataFrame) -> DataFrame:
    """Values of credential names that are no runs of their own."""
    some = reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(s)) for s in STEMS])
    rows = _spots(docs.where(some).where(F.col("text").rlike(GIVEN)), "text", GIVEN)
    part = lambda k: F.regexp_extract("m", GIVEN, k)
    quoted = (part(4) == "").cast("int")
    value = F.when(quoted == 1, F.concat(part(2), part(3))).otherwise(part(4))
    rows = rows.select("*", part(1).alias("name"), value.alias("_v"), (F.col("at") + F.length("m") - F.length(value) - quoted).alias("start"))
    rows = rows.withColumn("value", F.when(F.col("_v").rlike(r"[^.]\.+$") & (quoted == 0), F.rtrim("_v", F.lit("."))).otherwise(F.col("_v")))
    rows = rows.where((F.length("value") > 0) & ~_is_run("value"))
    lead = F.expr("substring(text, at + 1, start - at)")
    words = F.split(F.expr(f"substring(text, greatest(at - {NEAR}, 0) + 1, least(at, {NEAR}))"), r"\s+")
    after = F.split(F.expr(f"substring(text, at + length(m) + 1, {NEAR})"), r"\s+")
    near = F.when(lead.rlike(r"\s$"), F.regexp_replace(lead, r"\s", "")).otherwise(F.col("name"))
    return rows.select("doc_id", "start", "value", F.element_at(words, -1).alias("before2"), near.alias("before1"), F.coalesce(F.get(after, F.lit(1)), F.lit("")).alias("after1"), "name", "path")


def _is_run(value: str):
    return F.col(value).rlike(f"^{RUN}$") & F.col(value).rlike("[0-9]")


def _around(rows: DataFrame) -> DataFrame:
    """Findings from matches ``m`` at ``at`` whose ``value`` starts at ``start``, with the words beside them."""
    before = F.split(F.expr(f"substring(text, greatest(start - {NEAR}, 0) + 1, least(start, {NEAR}))"), r"[^\p{L}\p{N}_]+")
    after = F.filter(F.split(F.expr(f"substring(text, start + length(value) + 1, {NEAR})"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    before = F.concat(F.array(F.lit(""), F.lit("")), F.filter(before, lambda w: w != ""))
    return rows.select("doc_id", "start", "value", F.element_at(before, -2).alias("before2"), F.element_at(before, -1).alias("before1"), F.coalesce(F.get(after, F.lit(0)), F.lit("")).alias("after1"), "name", "path")


def _keys(docs: DataFrame) -> DataFrame:
    """Private keys, whole."""
    rows = _spots(docs.where(F.contains("text", F.lit("PRIVATE KEY"))), "text", PRIVATE)
    return _around(rows.select("*", F.rtrim("m", F.lit(" \r\n\t")).alias("value"), F.col("at").alias("start"), F.lit("private_key").alias("name")))


def _in_urls(docs: DataFrame) -> DataFrame:
    """Passwords in URLs that are no runs of their own."""
    rows = _spots(docs.where(F.contains("text", F.lit("://")) & F.col("text").rlike(IN_URL)), "text", IN_URL)
    rows = rows.withColumn("value", F.regexp_extract("m", r"://[^:]*:([^@]+)@$", 1))
    rows = rows.withColumn("start", F.col("at") + F.length("m") - 1 - F.length("value")).where(~_is_run("value"))
    return _around(rows.withColumn("name", F.lit("password")))


def findings(docs: DataFrame) -> DataFrame:
    """``(doc_id, start, value, before2, before1, after1, name, path)``; ``start`` counts characters from 0."""
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    some = docs.select("doc_id", "text", path.alias("path"))
    rows = reduce(DataFrame.unionByName, [_runs(some), _given(some), _keys(some), _in_urls(some)]).withColumn("start", F.col("start").cast("long"))
    return rows.withColumn("name", F.lower(F.regexp_replace("name", r"[^A-Za-z_]", ""))).withColumns({c: F.lower(c) for c in ("before2", "before1", "after1")})


def labelled(found: DataFrame) -> DataFrame:
    """Labels from a distance: 1.0 for fixed formats and for values of credential names."""
    prose = F.col("value").rlike("^[A-Z]?[a-z]+$") & F.col("before1").rlike(":$")
    given = F.col("name").rlike(f"^(?:[a-z_]*_)?(?:{NAMES})$") & (F.length("value") >= 4)
    yes = F.col("value").rlike(FORMATS) | given & ~prose
    return found.withColumn("label", yes.cast("double"))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Numbers of each finding. ``words`` is broadcast: its size is bounded by ``dictionary``."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    times = lambda two: (F.length("_shape") - F.length(F.replace("_shape", F.lit(two), F.lit("")))) / 2 / F.length("value")
    count = lambda pattern: F.length(F.regexp_replace("value", f"[^{pattern}]", "")) / F.length("value")
    parts = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{3,})"))).alias("word"))
    covered = parts.join(F.broadcast(words), "word").groupBy("value").agg(F.sum(F.length("word")).alias("_known"))
    return found.join(covered, "value", "left").withColumn("_shape", shape).withColumns(
        {
            "length": F.length("value").cast("double"),
            **{name: times(two) for name, two in TRANSITIONS.items()},
            "kinds": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
            "digits": count("0-9"),
            "upper": count("A-Z"),
            "signs": 1 - count("A-Za-z0-9"),
            "coverage": F.coalesce(F.col("_known"), F.lit(0)) / F.length("value"),
        }
    ).drop("_known", "_shape")


def _vectors(rows: DataFrame) -> DataFrame:
    hashed = FeatureHasher(inputCols=list(WORDS), outputCol="_words", numFeatures=256).transform(rows)
    return VectorAssembler(inputCols=[*NUMBERS, "_words"], outputCol="_x").transform(hashed)


def train(known: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 6):
    """A forest from rows with features and ``label``, or None unless both labels occur."""
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share = min(1.0, sample / sum(counts.values()))
    drawn = known if share == 1.0 else known.where(F.pmod(F.xxhash64("value", "start", "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    drawn = drawn.withColumn("_weight", F.when(F.col("label") == 1, F.lit(1 / counts[1.0])).otherwise(F.lit(1 / counts[0.0])) * sum(counts.values()) / 2)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", weightCol="_weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=7)
    return forest.fit(_vectors(drawn))


def scan(docs: DataFrame, known: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Every finding with its ``score`` (0 to 1) and ``is_secret``; ``known``: labelled findings to learn from instead."""
    # between the steps the driver is trimmed: their plans make much code
    trim_driver(docs.sparkSession)
    words = durable(dictionary(docs))
    trim_driver(docs.sparkSession)
    found = durable(labelled(findings(docs)))  # texts are read once
    trim_driver(docs.sparkSession)
    rows = durable(with_features(found, words))
    trim_driver(docs.sparkSession)
    model = train(rows if known is None else with_features(known, words))
    trim_driver(docs.sparkSession)
    if model is None:
        scored = rows.withColumn("score", F.col("label"))
    else:
        scored = model.transform(_vectors(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "value", "name", "path", "label", "score", (F.col("score") >= least).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every secret found masked where it stands, and one of eight characters or more wherever else in that text.

    All columns stay, whatever their names. Texts of one doc_id are masked by the values found in any of them.
    """
    spot = F.struct(F.col("start").cast("int").alias("start"), "value")
    of_doc = found.where("is_secret").groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set(spot)).alias("_spots"))
    others = F.struct(F.lit(0).alias("_" * (1 + max(map(len, docs.columns)))), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    rows = docs.select(others.alias("_row"), "doc_id", "text")
    d = rows.join(of_doc, rows["doc_id"].eqNullSafe(of_doc["_id"]), "left")
    piece = lambda a, b: F.substring("text", a + 1, F.greatest(b - a, F.lit(0)))
    # spots in order; one that begins inside the one before, or is not in this text, is left out
    here = lambda a, s: (s["start"] >= a["at"]) & (F.substring("text", s["start"] + 1, F.length(s["value"])) == s["value"])
    step = lambda a, s: F.when(here(a, s), F.struct(F.concat(a["out"], piece(a["at"], s["start"]), F.lit(MASK)).alias("out"), (s["start"] + F.length(s["value"])).alias("at"))).otherwise(a)
    masked = F.aggregate("_spots", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], piece(a["at"], F.length("text"))))
    long = F.array_distinct(F.filter(F.transform("_spots", lambda s: F.struct(F.length(s["value"]).alias("n"), s["value"].alias("v"))), lambda s: s["n"] >= 8))
    clean = F.aggregate(F.reverse(F.array_sort(long)), masked, lambda t, s: F.replace(t, s["v"], F.lit(MASK)))
    return d.select(*[(F.coalesce(clean, F.col("text")) if c == "text" else F.col(c) if c == "doc_id" else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op5_secret_scan(spark, sf_dir) -> DataFrame:
    """All findings of all documents, scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return scan(docs).select("doc_id", "start", "value", "name", F.round("score", 6).alias("score"), "is_secret")
