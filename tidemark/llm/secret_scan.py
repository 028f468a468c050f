"""Secret scans: candidates by rules, false positives removed by a random forest, all in DataFrame expressions.

A candidate is a run of key characters within a word (a signed web token with the points between its parts): of 16 or
more, or of any length if it starts as a known kind of key or its context announces a secret. Digits and case are left to the forest. Its features are length, character transitions, coverage by dictionary words, path shape and the neighbouring words. The
forest is fitted by Spark's own library on labelled findings and walked as an array expression, so scanning a
corpus is one projection over its words without user functions or a shuffle.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

CUT = 0.5
TREES, DEPTH = 20, 6
VALUE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
RUN = r"eyJ[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+|[A-Za-z0-9+/_\-]+={0,2}"
SHORT_PREFIX = r"gh[pousr]_|sk[-_]|xox[abp]-|eyJ"
KNOWN = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^(?:" + SHORT_PREFIX + ")"
FIELD = r"[^,;&?{}]"
# Words that placeholders, names and prose are made of; words that announce a secret, and those that announce something else.
DICTIONARY = "access account after article author backup before build cache change changeme client config content data default demo document download dummy enter example file first from header here image index insert item key latest main management message model module name network number page password path placeholder preview private process product project public report request resource response sample secret section server service session setting simple source state static string system table template test text that the this title token upload user value version with word your".split()
ANNOUNCE = "password passwd pwd secret token apikey api_key api-key access_key auth authorization bearer credential private_key client_secret aws key".split()
OTHER = "sha sha1 sha256 md5 checksum digest hash commit revision uuid guid id isbn doi version example sample placeholder see url path file image phone tel order invoice".split()
BIGRAMS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
FEATURES = ["length", "digit_share", "upper_share", "digit_letter_changes", "case_changes", "common_bigrams", "long_consonants", "dictionary_share", "distinct_share", "hex_only", "uuid_shape", "slashes", "path_shape", "separators", "announced", "other_context", "assigned", "known_prefix"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, value, word, context): a row per candidate of every whole text; place counts words from 0.

    Null and empty texts have no candidate. Every run of key characters in a word is a value of its own. Its context
    is the text before it; in a word of several fields, as of a query string or minified JSON, its own field.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+").alias("words"))
    rows = rows.withColumn("hits", F.transform("words", lambda w: F.lower(w).rlike(_tokens(ANNOUNCE))))
    hit = lambda i: F.exists(F.slice("hits", F.greatest(i - 2, F.lit(1)), F.least(i + 1, F.lit(4))), lambda h: h)
    apt = lambda w: w.rlike(VALUE) | w.rlike(r"(?:^|[^A-Za-z0-9+/_\-])(?:" + SHORT_PREFIX + ")")
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: apt(F.get("words", i)) | hit(i))
    near = lambda i, k: F.coalesce(F.get("words", i + k), F.lit(""))
    found = F.transform(at, lambda i: F.struct(i.cast("long").alias("place"), F.get("words", i).alias("word"), F.concat_ws(" ", near(i, -3), near(i, -2), near(i, -1)).alias("before"), near(i, 1).alias("after")))
    rows = rows.where(F.size("words") > 0).select(id_col, F.explode(found).alias("c")).select(id_col, "c.*")
    runs = _runs(rows.withColumn("runs", F.regexp_extract_all("word", F.lit(RUN), F.lit(0))), RUN, id_col)
    return runs.where(F.col("value").rlike("^" + VALUE) | F.col("value").rlike(KNOWN) | F.col("context").rlike(OPEN))


def _tokens(names: list[str]) -> str:
    return "(?:^|[^a-z])(?:" + "|".join(map(re.escape, names)) + ")(?:$|[^a-z])"


#: A context that announces a secret and holds no value for it yet.
OPEN = _tokens(ANNOUNCE).replace("(?:$|[^a-z])", r"(?:[^a-z=:][^=:]*)?(?:[=:]+>?[\s\"'\[({]*)?$")


def _runs(rows: DataFrame, pattern: str, id_col: str) -> DataFrame:
    """A row per run of ``runs``, all matches of ``pattern`` in ``word``, with its context."""
    rows = rows.withColumn("gaps", F.split("word", pattern, -1)).select(id_col, "place", "word", "before", "after", "runs", "gaps", F.posexplode("runs").alias("nth", "value"))
    ahead = F.concat(F.array_join(F.zip_with(F.slice("gaps", 1, F.col("nth")), F.slice("runs", 1, F.col("nth")), lambda g, r: F.concat(g, r)), ""), F.get("gaps", "nth"))
    rows = rows.withColumn("ahead", ahead).withColumn("field", F.regexp_extract("ahead", FIELD + "*$", 0))
    own = (F.col("field") != F.col("ahead")) & F.col("field").rlike("[A-Za-z]")
    behind = F.expr("substring(word, char_length(ahead) + char_length(value) + 1)")
    word = F.when(own, F.concat("field", "value", F.regexp_extract(behind, "^" + FIELD + "*", 0))).otherwise(F.col("word"))
    context = F.when(own, F.col("field")).otherwise(F.concat_ws(" ", "before", "ahead"))
    return rows.select(id_col, "place", "value", word.alias("word"), F.lower(context).alias("context"), "after")


def featured(found: DataFrame) -> DataFrame:
    """``found`` (value, word, context) with a double column per feature."""
    v, w, c = F.col("value"), F.col("word"), F.col("context")
    size = F.char_length(v).cast("double")
    count = lambda pattern, x=v: F.regexp_count(x, F.lit(pattern)).cast("double")
    words = "|".join(sorted(DICTIONARY, key=lambda x: (-len(x), x)))
    flag = lambda x: x.cast("int").cast("double")
    made = {
        "length": size,
        "digit_share": count("[0-9]") / size,
        "upper_share": count("[A-Z]") / size,
        "digit_letter_changes": (count("[0-9](?=[A-Za-z])") + count("[A-Za-z](?=[0-9])")) / size,
        "case_changes": (count("[a-z](?=[A-Z])") + count("[A-Z](?=[a-z])")) / size,
        "common_bigrams": count("(?=" + "|".join(BIGRAMS) + ")", F.lower(v)) / size,
        "long_consonants": count("[bcdfghjklmnpqrstvwxz]{4,}", F.lower(v)),
        "dictionary_share": 1 - F.char_length(F.regexp_replace(F.lower(v), words, "")) / size,
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / size,
        "hex_only": flag(v.rlike("^[0-9a-fA-F]+$")),
        "uuid_shape": flag(v.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
        "slashes": count("/"),
        "path_shape": flag(w.rlike(r"://|^www\.|^[./~]|/.*/|\.[a-z]{2,4}$")),
        "separators": count("[_-]"),
        "announced": flag(c.rlike(_tokens(ANNOUNCE))),
        "other_context": flag(c.rlike(_tokens(OTHER))),
        "assigned": flag(c.rlike(r"[=:]\s*[\"']?$")),
        "known_prefix": flag(v.rlike(KNOWN)),
    }
    return found.withColumns({k: F.coalesce(x, F.lit(0.0)) for k, x in made.items()})


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(value, word, context, label): findings as reviewers label them, made by rule from digests of a counter.

    No table of labelled findings exists here; any table with these columns takes this one's place in ``fit``.
    """
    d = F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")).cast("binary"), 512)
    pick = lambda k, m: F.conv(F.substring(d, 100 + 2 * (k % 14), 2), 16, 10).cast("int") % m
    of = lambda k, names: F.element_at(F.array(*map(F.lit, names)), pick(k, len(names)) + 1)
    b64 = F.regexp_replace(F.base64(F.unhex(F.substring(d, 1, 60))), "[+/=]", "")
    upper = F.substring(F.upper(F.translate(F.substring(b64, 1, 32), "-_", "AB")), 1, 16)
    word = lambda k: of(k, DICTIONARY)
    syllables = lambda k, n=5: F.concat(*[of(k + j, BIGRAMS) for j in range(n)])
    letters = F.translate(b64, "0123456789", "qXzKwJvHgB")
    hexes = lambda size: F.substring(d, 1, size)
    key = of(0, ["password", "token", "secret", "api_key", "auth", "access_key", "passwd"])
    other = of(1, ["commit", "sha256", "md5", "checksum", "uuid", "id", "revision", "digest", "file", "see"])
    prose = of(2, ["the", "of and", "was in", "de la", "und der", "in"])
    put = of(3, ["=", "= \"", ": ", "='", ":"])
    kinds = [
        (1, F.concat(F.lit("AKIA"), upper), F.concat(prose, F.lit(" "))), (1, F.concat(F.lit("AKIA"), upper), F.concat(key, put)),
        (1, hexes(18), F.concat(key, put)), (1, hexes(40), F.concat(key, put)), (1, F.substring(b64, 1, 24), F.concat(key, put)),
        (1, F.substring(b64, 1, 40), F.concat(prose, F.lit(" "))), (1, F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(prose, F.lit(" "))),
        (0, hexes(40), F.concat(other, F.lit(" "))), (0, hexes(64), F.concat(other, put)), (0, hexes(32), F.concat(other, F.lit(" "))),
        (0, F.regexp_replace(hexes(32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.concat(of(4, ["id", "uuid", "key", "the"]), put)),
        (0, F.concat(word(5), F.lit("/"), word(6), F.lit("/"), word(7), F.lit("-"), pick(8, 90).cast("string"), pick(9, 90).cast("string")), F.concat(of(4, ["https://example.com/", "path ", "see "]))),
        (0, F.concat(F.lit("your-"), word(5), F.lit("-"), word(6), F.lit("-here-"), pick(8, 90).cast("string"), F.lit("1")), F.concat(key, put)),
        (0, F.concat(word(5), F.initcap(word(6)), F.initcap(word(7)), F.initcap(word(8)), F.lit("10")), F.concat(of(4, ["function", "class", "the", "token"]), F.lit(" "))),
        (0, F.concat(syllables(5), syllables(11), pick(8, 90).cast("string"), F.lit("7")), F.concat(prose, F.lit(" "))),
        (0, F.lpad(F.conv(F.substring(d, 1, 12), 16, 10), 16, "4"), F.concat(of(4, ["order", "phone", "invoice", "isbn", "no."]), F.lit(" "))),
        (0, F.concat(F.lit("20240"), pick(6, 9).cast("string"), F.lit("-"), word(7), F.lit("_"), word(5), F.lit("_"), pick(8, 99).cast("string"), F.lit("x11")), F.concat(of(4, ["file", "image", "the"]), F.lit(" "))),
        (0, F.concat(word(5), F.lit("_"), word(6), F.lit("_"), of(7, ["secret", "token", "key", "password", "id"]), F.lit("=")), F.concat(prose, F.lit(" "))),
        (0, F.upper(F.concat(of(4, BIGRAMS), of(5, BIGRAMS), F.lit("_"), word(6), F.lit("_"), of(7, ["secret", "token", "key", "password", "id"]), F.lit("="))), F.concat(prose, F.lit(" "))),
        (1, F.concat(F.lit("AKIA"), F.translate(upper, "0123456789", "QXZKWJVHGB")), F.concat(prose, F.lit(" "))), (1, F.substring(letters, 1, 28), F.concat(key, put)),
        (1, F.substring(letters, 1, 40), F.concat(prose, F.lit(" "))), (1, hexes(10), F.concat(key, put)), (1, F.substring(b64, 1, 11), F.concat(key, put)),
        (1, F.concat(syllables(5, 3), pick(8, 99).cast("string")), F.concat(key, put)), (1, F.lower(F.substring(letters, 1, 10)), F.concat(key, put)),
        (0, word(5), F.concat(key, put)), (0, syllables(5, 2), F.concat(key, F.lit(" of "))), (0, word(5), F.concat(key, F.lit(" "))),
        (0, of(5, ["true", "false", "null", "none", "string", "required", "optional", "xxxx"]), F.concat(key, put)),
        (0, F.concat(syllables(5), syllables(10)), F.concat(prose, F.lit(" "))), (0, F.initcap(F.concat(syllables(5), syllables(10), syllables(15, 3))), F.concat(prose, F.lit(" "))),
        (0, F.upper(F.concat(syllables(5), syllables(10))), F.concat(prose, F.lit(" "))), (0, F.upper(F.concat(syllables(5, 4), syllables(9, 4), syllables(13))), F.concat(key, F.lit(" "))),
        (0, F.concat(word(5), F.lit("-"), syllables(6), F.lit("-"), word(12)), F.concat(prose, F.lit(" "))),
        (0, F.concat(word(5), F.initcap(word(6)), F.initcap(word(7)), F.initcap(word(8))), F.concat(prose, F.lit(" "))),
        (0, F.concat(word(5), F.lit("/"), syllables(6), F.lit("/"), word(12)), F.concat(of(4, ["https://example.com/", "path ", "see ", "the "]))),
    ]
    kind = F.element_at(F.array(*[F.struct(F.lit(y).alias("label"), v.alias("value"), c.alias("context")) for y, v, c in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    rows = spark.range(0, n, numPartitions=4).select("id", kind.alias("k")).select("id", "k.*")
    head = F.when(F.col("context").rlike(r"[=:/\"']$"), F.regexp_extract("context", r"\S*$", 0)).otherwise("")
    return rows.select("id", "value", F.concat(head, "value").alias("word"), F.lower("context").alias("context"), "label")


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> list:
    """Trees fitted on (value, word, context, label), each a list of nodes [feature, split, left, right]; a leaf has
    feature -1, its vote (0 or 1) as split, and itself as both ways on."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(featured(findings)).select("x", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows.repartition(1))
    return [_tree(t.toDebugString.splitlines()[1:]) for t in forest.trees]


def _tree(lines: list[str]) -> list:
    """Spark's printed tree: If and Else at equal depth, a leaf as Predict."""
    nodes: list = []

    def read(at: int) -> int:
        line, own = lines[at].strip(), len(nodes)
        if line.startswith("Predict:"):
            nodes.append([-1, float(line.split(":")[1]), own, own])
            return at + 1
        feature, split = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line).groups()
        nodes.append([int(feature), float(split), own + 1, 0])
        at = read(at + 1)
        nodes[own][3] = len(nodes)
        return read(at + 1)

    read(0)
    return nodes


def probability(trees: list, depth: int = DEPTH) -> Column:
    """The share of trees that vote for a secret, over array column ``x`` of features: each tree is walked from its root."""
    text = json.dumps([[{"f": f, "s": s, "l": a, "r": b} for f, s, a, b in t] for t in trees])
    forest = F.from_json(F.lit(text), "array<array<struct<f:int,s:double,l:int,r:int>>>")

    def vote(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            node = F.get(tree, at)
            return F.when(F.get(F.col("x"), node["f"]) <= node["s"], node["l"]).otherwise(node["r"])

        return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))["s"]

    return F.aggregate(forest, F.lit(0.0), lambda total, tree: total + vote(tree)) / max(1, len(trees))


def scan(docs: DataFrame, trees: list, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, place, value, score, is_secret): every candidate of every row, with the forest's share of votes.

    Rows repeat as they do in ``docs``; null ids stay null.
    """
    found = featured(candidates(docs, id_col, text_col)).select(id_col, "place", "value", F.explode(F.array(F.array(*FEATURES))).alias("x"))  # features are made once, not once a node
    found = found.withColumn("score", F.round(probability(trees), 6))
    return found.select(id_col, "place", "value", "score", (F.col("score") >= cut).alias("is_secret"))


def redact(docs: DataFrame, trees: list, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, secrets): the distinct values to remove from each id's texts, for ids that have any."""
    return scan(docs, trees, id_col, text_col, cut).where("is_secret").groupBy(id_col).agg(F.array_sort(F.collect_set("value")).alias("secrets"))
