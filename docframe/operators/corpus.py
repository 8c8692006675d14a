"""Analytics over a whole corpus: topics, similarity, revisions, routing, audits, summaries and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.text import tokens, word_count
from docframe.sources.sinks import written


def topics(docs: DataFrame, most: int = 5) -> DataFrame:
    """Of each document its most frequent words of over three letters; ties in alphabetical order."""
    words = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("topic")).filter(F.length("topic") > 3)
    counts = words.groupBy("doc_id", "topic").agg(F.count("*").alias("uses"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("uses"), "topic"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "topic", "uses", "rank")


def topic_classes(found: DataFrame) -> DataFrame:
    """doc_id, class_id, topics: documents with the same set of topics are a class, named by its smallest doc_id."""
    sets = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    classes = sets.groupBy("topics").agg(F.min("doc_id").alias("class_id"))
    return sets.join(classes, "topics").select("doc_id", "class_id", "topics")


def topic_pairs(found: DataFrame, least: float = 0.2) -> DataFrame:
    """a < b, jaccard: all pairs of classes of at least that similarity; topic_classes() has the members.

    Sets of n and m topics that similar share at least least / (1 + least) * (n + m) topics. Where that is over one, classes meet by two
    topics together, so that a frequent topic alone starts no pair; only small sets meet by a single one.
    """
    sets = topic_classes(found).filter("doc_id = class_id").select("class_id", "topics", F.size("topics").alias("n"))
    single = int((1 + least) / least + 1e-9)
    left = lambda keys: sets.select(F.col("class_id").alias("a"), F.col("topics").alias("ta"), F.col("n").alias("na"), F.explode(keys).alias("key"))
    right = lambda keys: sets.select(F.col("class_id").alias("b"), F.col("topics").alias("tb"), F.col("n").alias("nb"), F.explode(keys).alias("key"))
    twos = F.flatten(F.transform("topics", lambda x, i: F.transform(F.slice("topics", i + 2, F.size("topics")), lambda y: F.concat_ws("\n", x, y))))
    ones = F.when(F.col("n") < single, F.col("topics")).otherwise(F.array().cast("array<string>"))
    jaccard = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    small = F.col("na") + F.col("nb") <= single
    parts = [left(k).join(right(k), "key").filter((F.col("a") < F.col("b")) & (small if k is ones else ~small) & (jaccard >= least)) for k in (ones, twos)]
    return parts[0].unionByName(parts[1]).select("a", "b", F.round(jaccard, 6).alias("jaccard")).distinct()


def topic_links(found: DataFrame, least: float = 0.2) -> DataFrame:
    """doc_id, class_id, links: each document's class, and the number of other classes of at least that similarity (topic_pairs() has them one by one).

    No pair is made. Sets of n and m topics are similar if they share o topics or more; how many sets of m topics share so many with a set
    follows from how many of them hold each of its subsets, by inclusion and exclusion. A set of n topics has 2^n - 1 subsets, so sets are to be
    small, as those of topics() are.
    """
    members = written(topic_classes(written(found.select("doc_id", "topic"))))
    sets = members.filter("doc_id = class_id").select("class_id", "topics", F.size("topics").alias("n"))
    # the subsets of topics: with each topic all that there were before, with it and without it
    subsets = F.aggregate("topics", F.array(F.slice("topics", 1, 0)), lambda done, x: F.concat(done, F.transform(done, lambda s: F.concat(s, F.array(x)))))
    rows = sets.select("class_id", "n", F.explode(subsets).alias("part")).filter(F.size("part") > 0).select("class_id", "n", F.array_join("part", "\n").alias("key"), F.size("part").alias("k"))
    holders = rows.groupBy("key", F.col("n").alias("m")).agg(F.count("*").alias("holders"))
    shared = F.filter(F.sequence(F.lit(1), F.least("n", "m")), lambda i: i / (F.col("n") + F.col("m") - i) >= least)
    met = rows.join(holders, "key").groupBy("class_id", "n", "m", "k").agg(F.sum("holders").alias("holders")).withColumn("o", F.get(shared, F.lit(0))).filter("k >= o")
    # of the sets that share at least o topics each is counted once: (-1)^(k - o) * C(k - 1, o - 1) times for each shared subset of k topics
    choose = F.aggregate(F.sequence(F.lit(0), F.col("o") - 1), F.lit(1).cast("long"), lambda c, i: F.when(i == 0, c).otherwise((c * (F.col("k") - i) / i).cast("long")))
    sign = F.when((F.col("k") - F.col("o")) % 2 == 0, 1).otherwise(-1)
    links = met.groupBy("class_id").agg((F.sum(sign * choose * F.col("holders")) - 1).alias("links"))  # without the class itself
    return members.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def revision_diff(old: DataFrame, new: DataFrame, keys: list[str], item: str) -> DataFrame:
    """added, removed or common, for each distinct item of two revisions."""
    a = old.select(*keys, item).distinct().withColumn("in_old", F.lit(True))
    b = new.select(*keys, item).distinct().withColumn("in_new", F.lit(True))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("common")
    return a.join(b, [*keys, item], "full").select(*keys, item, state.alias("state"))


def complexity(chunks: Column, tables: Column, equations: Column, references: Column, columns: Column) -> Column:
    score = F.when(chunks > 30, 2).when(chunks > 10, 1).otherwise(0) + sum((F.when(c, 1).otherwise(0) for c in (tables > 0, equations > 0, references > 5, columns > 1)), F.lit(0))
    return F.when(score >= 4, "complex").when(score >= 2, "moderate").otherwise("simple")


# The words by which a document's terms name its kind, in order.
KIND_WORDS = (("medical", "clinical|patient|medical|diagnosis|treatment"), ("legal", "legal|compliance|regulation|gdpr|hipaa|contract"), ("financial", "financial|revenue|earnings|fiscal|audit"))


def kind_of_terms(terms: Column, refs: Column, doi: Column) -> Column:
    """medical, legal or financial by any of the terms (lower-cased), research by over 5 references or a DOI, else other."""
    named = lambda words: F.exists(terms, lambda t: F.lower(t).rlike(rf"\b({words})\b"))
    case = reduce(lambda c, k: c.when(named(k[1]), k[0]), KIND_WORDS[1:], F.when(named(KIND_WORDS[0][1]), KIND_WORDS[0][0]))
    return case.when((refs > 5) | doi.isNotNull(), "research").otherwise("other")


def route(docs: DataFrame) -> DataFrame:
    """doc_id, complexity, route, priority from (doc_id, kind, chunks, tables, equations, refs, columns)."""
    level = complexity(*(F.col(c) for c in ("chunks", "tables", "equations", "refs", "columns")))
    rows = docs.select("doc_id", "kind", level.alias("complexity"))
    kind, hard = F.col("kind"), F.col("complexity")
    cases = [((kind == "medical") & (hard == "complex"), "specialist", 1), (kind == "legal", "legal", 2), (kind == "financial", "finance", 2), ((kind == "research") & (hard != "simple"), "research", 3), (hard == "simple", "quick", 5)]
    pick = lambda k, other: reduce(lambda c, x: c.when(x[0], x[k]), cases[1:], F.when(cases[0][0], cases[0][k])).otherwise(other)
    return rows.select("doc_id", "complexity", pick(1, "general").alias("route"), pick(2, 4).alias("priority"))


def audit(titles: DataFrame, chunks: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """doc_id, rule, covered, evidence: a title has any of the rule's terms, or a chunk at least half of them (rounded up)."""
    found = []
    for name, terms in rules.items():
        title, content = F.lower("title"), F.lower("content")
        by_title = titles.filter(reduce(lambda a, b: a | b, [title.contains(t) for t in terms])).select("doc_id", F.lit(1).alias("hits"))
        many = sum((F.when(content.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
        by_chunk = chunks.filter(many >= -(-len(terms) // 2)).select("doc_id", F.lit(1).alias("hits"))
        counts = by_title.unionByName(by_chunk).groupBy("doc_id").agg(F.sum("hits").alias("hits"))
        whole = titles.select("doc_id").distinct().join(counts, "doc_id", "left")
        found.append(whole.select("doc_id", F.lit(name).alias("rule"), F.col("hits").isNotNull().alias("covered"), F.least(F.lit(3), F.coalesce("hits", F.lit(0))).cast("int").alias("evidence")))
    return reduce(DataFrame.unionByName, found)


def batch_summary(docs: DataFrame, by: list[str]) -> DataFrame:
    """Documents, characters, words and the share of failures (null texts) by groups."""
    words = word_count(F.coalesce("text", F.lit("")))
    return docs.groupBy(*by).agg(F.count("*").alias("documents"), F.count_if(F.col("text").isNull()).alias("failed"), F.sum(F.length("text")).alias("characters"), F.sum(words).alias("words"), F.round(F.avg(words), 4).alias("mean_words"))


def vertices(*tables: DataFrame) -> DataFrame:
    """id, kind, label over tables in order; the first table that has an id gives its vertex."""
    parts = [t.select("id", "kind", "label").withColumn("source", F.lit(i)) for i, t in enumerate(tables)]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("id").agg(F.min_by(F.struct("kind", "label"), F.struct("source", "kind", "label")).alias("v")).select("id", "v.kind", "v.label")


def edges(*tables: DataFrame) -> DataFrame:
    """src, dst, relation of all tables; repeated edges stay."""
    return reduce(DataFrame.unionByName, [t.select("src", "dst", "relation") for t in tables])


def pick_context(chunks: DataFrame, budget: int) -> DataFrame:
    """Of each document's ranked chunks those that fit a token budget: in order of rank, one that does not fit is passed over."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        for tokens_held in part.sort_values("rank")["token_count"]:
            keep.append(tokens_held <= left)
            left -= tokens_held if keep[-1] else 0
        return part.sort_values("rank")[keep]

    return chunks.groupBy("doc_id").applyInPandas(run, chunks.schema)


def clusters(keywords: DataFrame, group: str, shared: int = 2) -> DataFrame:
    """Greedy survey clusters within each group: the first document left seeds one, others join that share keywords with it, whose set grows."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sets = {d: set(g["keyword"]) for d, g in part.sort_values("doc_id").groupby("doc_id")}
        rows, left = [], list(sets)
        while left:
            seed, *others = left
            grown, members = set(sets[seed]), [seed]
            for d in others:
                if len(grown & sets[d]) >= shared:
                    grown |= sets[d]
                    members.append(d)
            rows += [(part[group].iloc[0], seed, d) for d in members]
            left = [d for d in left if d not in set(members)]
        return pd.DataFrame(rows, columns=[group, "cluster", "doc_id"])

    kind = dict(keywords.dtypes)[group]
    return keywords.groupBy(group).applyInPandas(run, f"{group} {kind}, cluster long, doc_id long")
