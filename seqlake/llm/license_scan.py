"""License scan by diagonal voting.

Hashes of every two neighbouring words of every document meet those of phrases and notices in a join.  A hit votes for
a diagonal, the document's position less the template's; a phrase stands where all its word pairs vote for one
diagonal.  A notice may have lost or gained words, so neighbouring diagonals are merged; where they hold enough of its
word pairs, each counted once, the words around are compared with the notice's in order, and as many must be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are what stands between these, A-Z lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices, whose words may differ a little, and their labels.
NOTICES = (
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
)
GRAM = 2
#: Diagonals this near vote together; share of a notice's word pairs, and of its words in order, that must be there.
NEAR, SHARE = 2, 0.8
#: Word pairs of templates up to this number go to every task (some 300 bytes each); more are joined by shuffle.
BROADCAST_PAIRS = 100_000


def words(text: Column) -> Column:
    """Lower-case words by the contract.  KELVIN SIGN is kept from becoming k; no other letter becomes one of a-z."""
    kept = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit(""))
    return F.split(F.lower(kept), SEPARATORS)


_PAIRS = "template int, label string, at int, first string, second string, pairs int, exact boolean, words array<string>"


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, at, first, second, pairs, exact, words): the word pairs of each template, and how many it has."""
    rows = []
    for t, (text, label, exact) in enumerate([(p, x, True) for p, x in phrases] + [(p, x, False) for p, x in notices]):
        w = text.split()
        rows += [(t, label, i, w[i], w[i + 1], len(w) - 1, exact, w) for i in range(len(w) - 1)]
    return spark.createDataFrame(rows, _PAIRS)


def in_order(words: Column, template: Column) -> Column:
    """How many words of ``template`` stand in ``words`` in the same order (the longest common subsequence)."""

    def step(before: Column, word: Column) -> Column:
        more = F.transform(template, lambda t, i: F.greatest(F.get(before, i), F.when(i > 0, F.get(before, i - 1)).otherwise(F.lit(0)) + (t == word).cast("int")))
        return F.transform(more, lambda _, i: F.array_max(F.slice(more, F.lit(1), i + 1)))

    return F.coalesce(F.array_max(F.aggregate(words, F.transform(template, lambda _: F.lit(0)), step)), F.lit(0))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES, spans: bool = False) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score[, spans]) per row of ``docs``.

    n_base counts the places of phrases, first_word and last_word are the first and the last such place; base_labels and
    labels (phrases and notices) are distinct, sorted and joined by commas; score is 1 with a phrase, else the largest
    share of a notice found in a place of it, else 0: the lesser one of its word pairs and of its words in order.  ``spans`` adds (label, first word, share) of
    each place.  A text without words, or null, has no places: null first_word and last_word, empty labels, score 0.
    Texts of any length are read whole.  Repeated rows and null keys each get a row.  Other columns are not read.
    """
    spark = docs.sparkSession
    grams = templates(spark, phrases, notices).select(F.xxhash64("first", "second").alias("gram"), "*")
    few = sum(len(p.split()) - 1 for p, _ in (*phrases, *notices)) <= BROADCAST_PAIRS
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("w"))
    own = own.select("row", "key", F.when((F.get("w", F.lit(0)) == "") | (F.element_at("w", -1) == ""), F.filter("w", lambda x: x != "")).otherwise(F.col("w")).alias("w"))
    own = own.select("row", "key", F.size("w").cast("long").alias("n_words"), "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - GRAM, F.lit(-1)))).alias("p"))
    first, second = F.get("w", F.col("p")), F.get("w", F.col("p") + 1)
    own = own.withColumn("gram", F.when(F.col("p") >= 0, F.xxhash64(first, second)).otherwise(F.lit(0).cast("long")))
    # Each document's own row, at place -1, goes on whether there are hits or not.
    nothing = spark.createDataFrame([(0, -1, None, 0, None, None, 1, False, None)], "gram long, " + _PAIRS)
    same = ((F.col("p") < 0) & (F.col("template") < 0)) | ((F.col("p") >= 0) & (F.col("first") == first) & (F.col("second") == second))
    if few:
        hits = own.join(F.broadcast(grams.unionByName(nothing)), "gram").where(same)
    else:
        hits = own.where("p >= 0").join(grams, "gram").where(same).unionByName(own.where("p < 0").join(F.broadcast(nothing), "gram").select(*own.columns, *nothing.columns[1:]))
    diagonal = F.col("p") - F.col("at")
    begin = F.greatest(diagonal - NEAR, F.lit(0))
    span = F.when((F.col("template") >= 0) & ~F.col("exact"), F.slice("w", begin + 1, diagonal + NEAR + F.size("words") - begin))
    by = ["row", "key", "n_words", "template", "label", "pairs", "exact", "words"]
    votes = hits.select(*by, diagonal.alias("diagonal"), "at", span.alias("span")).groupBy(*by, "diagonal").agg(F.collect_set("at").alias("at"), F.first("span").alias("span"))
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    merged = votes.withColumn("near", F.size(F.array_distinct(F.flatten(F.collect_list("at").over(near)))))
    phrase = (F.col("template") >= 0) & F.col("exact") & (F.size("at") == F.col("pairs"))
    voted = (F.col("template") >= 0) & ~F.col("exact") & (F.col("near") >= SHARE * F.col("pairs"))
    merged = merged.withColumn("phrase", phrase).withColumn("share", F.when(voted, F.least(F.col("near") / F.col("pairs"), in_order(F.col("span"), F.col("words")) / F.size("words"))))
    notice = F.coalesce(F.col("share") >= SHARE, F.lit(False))
    place = F.when(F.col("phrase"), F.col("diagonal").cast("long"))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = [
        F.count_if("phrase").alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        labels(F.col("phrase")).alias("base_labels"), labels(F.col("phrase") | notice).alias("labels"), F.coalesce(F.max(F.when(F.col("phrase"), F.lit(1.0)).when(notice, F.col("share"))), F.lit(0.0)).alias("score"),
    ]
    if spans:
        where = F.struct("label", F.col("diagonal").alias("first_word"), F.when(F.col("phrase"), F.lit(1.0)).otherwise(F.col("share")).alias("share"))
        out.append(F.array_sort(F.collect_list(F.when(F.col("phrase") | notice, where))).alias("spans"))
    return merged.groupBy("row", "key", "n_words").agg(*out).drop("row").withColumnRenamed("key", key)


_TEMPLATES = ", ".join(f"({t}, '{x}', {exact}, string_split('{p}', ' '))" for t, (p, x, exact) in enumerate([(p, x, "true") for p, x in PHRASES] + [(p, x, "false") for p, x in NOTICES]))
#: Words are compared place by place here: phrases at each word, notices at each diagonal that some pair of words votes for.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
t AS (SELECT *, len(tw) AS m FROM (VALUES {_TEMPLATES}) AS t(template, label, exact, tw)),
p AS (SELECT r, w, template, label, m, tw, exact, unnest(range(-m, len(w))) AS s FROM d, t WHERE list_has_any(w, tw)),
b AS (SELECT r, label, s FROM p WHERE exact AND s >= 0 AND w[s + 1 : s + m] = tw),
v AS (SELECT r, w, template, label, m, tw, s, list_filter(range(m - 1), lambda i: s + i >= 0 AND w[s + i + 1] = tw[i + 1] AND w[s + i + 2] = tw[i + 2]) AS hit FROM p WHERE NOT exact),
n AS (SELECT *, len(list_distinct(flatten(list(hit) OVER (PARTITION BY r, template ORDER BY s RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING)))) AS near FROM v WHERE len(hit) > 0),
c AS (SELECT r, label, m, tw, near, list_transform(w[greatest(s - {NEAR}, 0) + 1 : s + {NEAR} + m], lambda x: list_transform(tw, lambda y: (x = y)::INTEGER)) AS same FROM n WHERE near >= {SHARE} * (m - 1)),
l AS (SELECT r, label, m, near, list_max(list_reduce(same, lambda a, b: list_transform(range(m), lambda j: list_max(list_transform(range(j + 1), lambda i: greatest(a[i + 1], coalesce(a[i], 0) + b[i + 1])))), list_transform(tw, lambda y: 0))) AS lcs FROM c),
f AS (SELECT r, label, s, 1.0::DOUBLE AS share FROM b UNION ALL SELECT r, label, NULL, least(near::DOUBLE / (m - 1), lcs::DOUBLE / m) FROM l WHERE lcs >= {SHARE} * m),
s AS (SELECT r, count(s) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (s IS NOT NULL) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN s USING (r)
"""
