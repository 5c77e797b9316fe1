"""A table of rules in order, and the first that holds of each text.

Rules are rows: rank, code, scope, a word that a text must have, a pattern. A
rule with a word is found by equality with the text's words and its pattern
then tried on that text alone, so the rules may be very many; the few without
one are tried on every text of their scope, each compiled once. The smallest
rank decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules without a word, at most: these are part of the plan.
OPEN = 500
TOKEN = r"[\p{L}\p{N}_]+"


def first_rules(texts: DataFrame, key: str, scope: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, rank, code): for every row of texts (key unique) the first rule that holds, nulls where none does.

    rules: rank (unique, not null), code, scope (null: any), word (lower case,
    letters and digits; null: none), pattern (null: the word is enough). A null
    text has no rule. Words are compared in lower case, patterns as they are.
    """
    rows = texts.select(F.col(key), F.col(scope).alias("_scope"), F.col(text).alias("_text"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(TOKEN), 0))
    worded = rules.where("word IS NOT NULL").select("rank", "code", F.col("scope").alias("_rule_scope"), "word", "pattern")
    # Only ids travel to find the rules that a text may meet; texts join once more, those with a candidate alone.
    met = rows.select(key, "_scope", F.explode(tokens).alias("word")).join(worded, "word").where("_rule_scope IS NULL OR _rule_scope = _scope").select(key, "rank", "code", "pattern")
    sure = met.where("pattern IS NULL").select(key, "rank", "code")
    tried = met.where("pattern IS NOT NULL").join(rows.select(key, "_text"), key).where("_text RLIKE pattern").select(key, "rank", "code")
    open_ = rules.where("word IS NULL").orderBy("rank").limit(OPEN + 1).collect()
    if len(open_) > OPEN:
        raise ValueError(f"over {OPEN} rules without a word: give them one that their texts must have")

    def holds(r) -> Column:
        tests = ([F.col("_scope") == r["scope"]] if r["scope"] is not None else []) + ([F.col("_text").rlike(r["pattern"])] if r["pattern"] is not None else [F.col("_text").isNotNull()])
        return reduce(lambda a, b: a & b, tests)

    found = sure.unionByName(tried)
    if open_:
        first = F.coalesce(*(F.when(holds(r), F.struct(F.lit(r["rank"]).cast("long").alias("rank"), F.lit(r["code"]).alias("code"))) for r in open_))
        found = found.unionByName(rows.select(key, first.alias("r")).where("r IS NOT NULL").select(key, "r.rank", "r.code"))
    best = found.groupBy(key).agg(F.min("rank").alias("rank"), F.min_by("code", "rank").alias("code"))
    return rows.select(key).join(best, key, "left")
