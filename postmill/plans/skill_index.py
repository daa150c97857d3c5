"""Skill extraction against a dictionary table of any size, through a positional index.

The postings are read once. Each field is cut into tokens, runs of word characters or
single other ones, and those that are an alias or stand beside a token as in some alias are
kept with their place; a bitmap of the dictionary's neighbours decides, so neither the dictionary nor a text crosses the
network or the driver. That index is written once. Every alias is then looked up by the
one of its tokens that occurs least, and the places of its other tokens are intersected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.fixed import SEARCH_FIELDS
from postmill.functions.matching import STUDY_FIELD_RULE, ContextRule, alias_hits
from postmill.functions.text import casefold_sort, drop_urls, fold, squash, strip
from postmill.operators.buckets import BUCKETS, bitmap, bucket_of, in_bitmap
from postmill.operators.shared import settled
from postmill.operators.skew import join_group_facts
from postmill.plans.views import KEY

# A token with the blank before it, if there is one. Texts are squashed: no other blanks.
TOKEN = " ?(?:[a-z0-9_]+|[^a-z0-9_ ])"
ALIAS = ["skill_key", "alias"]


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), 0)


def _is_word(token: Column) -> Column:
    return F.ltrim(token).rlike("^[a-z0-9_]")


def alias_table(dictionary: DataFrame) -> DataFrame:
    """(skill_key, alias, needle, spelled): every alias of every skill once, with its tokens."""
    alias = strip(F.col("alias"))
    return (dictionary.select("skill_key", F.explode(F.split("aliases", r"\|")).alias("alias"))
            .select("skill_key", alias.alias("alias")).filter("alias <> ''").distinct()
            .withColumn("needle", fold(squash(F.col("alias"))))
            .withColumn("spelled", tokens(F.col("needle"))))


def _exploded(aliases: DataFrame) -> DataFrame:
    """One row per token of an alias, with its place."""
    return (aliases.select(*ALIAS, "spelled", F.posexplode("spelled").alias("offset", "_tok"))
            .withColumn("token", F.ltrim("_tok")).drop("_tok"))


def _neighbours(aliases: DataFrame) -> DataFrame:
    """(token, following): every two tokens that follow one another in an alias, and the
    token of every alias that has no other, with null."""
    spelled = F.transform("spelled", lambda t: F.ltrim(t))
    pairs = F.transform(spelled, lambda t, i: F.struct(
        t.alias("token"), F.get(spelled, i + 1).alias("following")))
    return aliases.select(F.explode(pairs).alias("p"), F.size("spelled").alias("tokens")).select(
        "p.*", "tokens").filter("following is not null or tokens = 1").drop("tokens")


def token_index(jobs: DataFrame, aliases: DataFrame, rules: Sequence[ContextRule],
                fields: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """One row per place of a token of the dictionary, and per hit of a skill with a rule.

    Places, of tokens with a neighbour as in an alias: the key, the field, `token`, its number `at`, whether a blank stands before it,
    and whether a term that begins or ends with it may do so there. A context rule reads
    the text around a hit, so the few skills that rules name are matched in this pass, in
    the row of the text; those rows have `skill_key` and `alias` instead.
    """
    known = bitmap(_neighbours(aliases).select(
        bucket_of(F.col("token"), F.col("following"), buckets=buckets).alias("bucket")), "bucket", buckets)
    texts = jobs.select(KEY, *[fold(drop_urls(F.col(f))).alias(f"_{f}") for f in fields]).select(
        KEY, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("text"))
                                for f in fields])))
    cut = texts.withColumn("all", tokens(F.col("text")))
    # A token's row has its two neighbours, not the tokens of the whole text.
    found = F.transform("all", lambda t, i: F.struct(
        i.alias("at"), t.alias("tok"), F.get("all", i - 1).alias("last"),
        F.get("all", i + 1).alias("following"), F.lit(None).cast("string").alias("skill_key"),
        F.lit(None).cast("string").alias("alias")))
    if rules:
        entry = F.struct("skill_key", "alias", "needle", F.lit("").alias("anchor"))
        named = (aliases.filter(F.col("skill_key").isin(*[r.skill for r in rules]))
                 .agg(F.collect_list(entry)).scalar())
        cut = cut.withColumn("ruled", named)
        found = F.concat(found, F.transform(
            alias_hits(F.col("text"), F.col("ruled"), rules), lambda h: F.struct(
                F.lit(-1).alias("at"), *[F.lit(None).cast("string").alias(c)
                                         for c in ("tok", "last", "following")],
                h["skill_key"].alias("skill_key"), h["alias"].alias("alias"))))
    rows = (cut.select(KEY, "field", F.explode(found).alias("f"))
            .select(KEY, "field", "f.*").withColumn("token", F.ltrim("tok")))
    token, last, following = F.col("token"), F.col("last"), F.col("following")
    wanted = F.col("skill_key").isNotNull()
    for pair in ((token, F.lit(None).cast("string")), (F.ltrim(last), token), (token, F.ltrim(following))):
        wanted = wanted | in_bitmap(known, bucket_of(*pair, buckets=buckets))
    kept = rows.filter(wanted)
    spaced, word = F.col("tok").startswith(" "), _is_word(token)
    return kept.select(
        KEY, "field", "token", "at", spaced.alias("spaced"),
        (word | spaced | last.isNull() | ~_is_word(last)).alias("may_begin"),
        (word | following.isNull() | following.startswith(" ") | ~_is_word(following))
        .alias("may_end"), *ALIAS)


def rarest_tokens(aliases: DataFrame, places: DataFrame) -> DataFrame:
    """Each alias all of whose tokens occur, with the token that does so least."""
    uses = places.groupBy("token").agg(F.count("*").alias("uses"))
    counted = join_group_facts(_exploded(aliases), uses, ["token"], ALIAS)
    return (counted.groupBy(*ALIAS)
            .agg(F.min(F.struct("uses", "offset", "token")).alias("rarest"),
                 F.count("*").alias("seen"), F.first("spelled").alias("spelled"))
            .filter(F.col("seen") == F.size("spelled"))
            .select(*ALIAS, "spelled", "rarest.offset", "rarest.token"))


def _fits(offset: Column, spelled: Column) -> Column:
    """Whether a place may be the given token of an alias, blanks and ends considered."""
    blank = F.get(spelled, offset).startswith(" ")
    return (F.when(offset == 0, F.col("may_begin")).otherwise(F.col("spaced") == blank)
            & ((offset < F.size(spelled) - 1) | F.col("may_end")))


def alias_places(places: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, field, skill_key, alias) of every alias that occurs as a whole term.

    Tokens that very many places or aliases share are dealt over slices; the other tokens
    are joined by key, field and place, of which no value is frequent.
    """
    begun = (join_group_facts(places, rarest_tokens(aliases, places), ["token"],
                              [KEY, "field", "at"])
             .filter(_fits(F.col("offset"), F.col("spelled")))
             .select(KEY, "field", *ALIAS, "spelled", "offset",
                     (F.col("at") - F.col("offset")).alias("start")))
    single = begun.filter(F.size("spelled") == 1).select(KEY, "field", *ALIAS)
    asked = (begun.filter((F.size("spelled") > 1) & (F.col("start") >= 0))
             .select("*", F.posexplode("spelled").alias("nth", "tok"))
             .filter("nth <> offset")
             .withColumn("at", F.col("start") + F.col("nth"))
             .withColumn("token", F.ltrim("tok")).drop("tok"))
    met = asked.join(places, [KEY, "field", "at", "token"]).filter(
        _fits(F.col("nth"), F.col("spelled")))
    whole = (met.groupBy(KEY, "field", *ALIAS, "start")
             .agg(F.count("*").alias("n"), F.first(F.size("spelled")).alias("all"))
             .filter("n = all - 1").select(KEY, "field", *ALIAS))
    return single.unionByName(whole)


def extract_skills_joined(jobs: DataFrame, dictionary: DataFrame,
                          rules: Sequence[ContextRule] = (STUDY_FIELD_RULE,),
                          fields: Sequence[str] = SEARCH_FIELDS,
                          buckets: int = BUCKETS) -> DataFrame:
    """`skills.extract_skills` for a dictionary table (skill_key, aliases) of any size.

    The corpus is read once however large the dictionary is. `buckets` sizes the bitmap of
    the dictionary's tokens: with very many tokens a larger one keeps the index smaller.
    """
    aliases = alias_table(dictionary)
    index = settled(token_index(jobs, aliases, rules, fields, buckets), "skill-index")
    ruled = [r.skill for r in rules]
    others = aliases.filter(~F.col("skill_key").isin(*ruled)) if ruled else aliases
    places = index.filter("skill_key is null").drop(*ALIAS)
    hits = alias_places(places, others).unionByName(
        index.filter("skill_key is not null").select(KEY, "field", *ALIAS))
    return (hits.groupBy(KEY, "skill_key")
            .agg(F.array_sort(F.collect_set("field")).alias("where"),
                 F.collect_set("alias").alias("aliases"))
            .select(KEY, "skill_key", F.array_join("where", "|").alias("evidence_source"),
                    F.array_join(casefold_sort(F.col("aliases")), "|").alias("matched_aliases"),
                    F.size("where").alias("evidence_field_count")))
