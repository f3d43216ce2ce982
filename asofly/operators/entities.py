"""Entities from free-text names: keys, veto rules, components and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.functions.text import is_untrusted_key, looks_like_dev_code, match_pattern, normalise, suffixes_in
from asofly.operators.graph import connected_components


def identity_keys(mentions: DataFrame, mention: str, name: str, others: str) -> DataFrame:
    """(mention, key, position): a mention's normalised names that may join entities."""
    names = F.concat(F.array(F.col(name)), F.coalesce(F.col(others), F.array().cast("array<string>")))
    return mentions.select(mention, F.posexplode(F.array_distinct(F.transform(names, normalise))).alias("position", "key")).where(F.col("key").isNotNull() & ~is_untrusted_key("key"))


def name_edges(keys: DataFrame, mention: str) -> DataFrame:
    """Edges between a mention's keys, unless they name several compounds (two suffixes or more).

    All keys of a mention are linked to its least one: a star, not all pairs.
    """
    per = keys.groupBy(mention).agg(F.min("key").alias("a"), F.array_distinct(F.flatten(F.collect_set(suffixes_in("key")))).alias("suffixes"))
    one = per.where(F.size("suffixes") < 2).select(mention, "a")
    linked = keys.join(one, mention).select("a", F.col("key").alias("b"))
    return linked.unionByName(keys.select(F.col("key").alias("a"), F.col("key").alias("b"))).distinct()


def anchor_edges(keys: DataFrame) -> DataFrame:
    """An edge from a key to a longer one that holds it as whole words, unless their suffixes differ.

    Found by an equi-join on runs of words: each key is expanded into its own word runs of
    the lengths that anchors have, and a run that is itself a key is the match.
    """
    names = keys.select("key").distinct()
    anchors = names.select(F.col("key").alias("a")).where(F.length("a") >= 4)
    held = _word_runs(names, "key", F.split("key", " "), anchors.select(F.size(F.split("a", " ")).alias("n"))).select(F.col("key").alias("b"), F.col("run").alias("a")).where("a <> b")
    differ = (F.size(suffixes_in("a")) > 0) & (F.size(suffixes_in("b")) > 0) & (F.array_join(suffixes_in("a"), ",") != F.array_join(suffixes_in("b"), ","))
    return held.join(anchors, "a").where(~differ).select("a", "b")


def cluster_names(mentions: DataFrame, mention: str, name: str, others: str) -> DataFrame:
    """(mention, cluster_id): clusters of mentions by shared names; a cluster is named by a digest of its least key.

    A mention without any trusted key is a cluster of its own by its normalised name.
    """
    keys = identity_keys(mentions, mention, name, others)
    component = connected_components(name_edges(keys, mention).unionByName(anchor_edges(keys)), "a", "b")
    rooted = keys.join(component, keys["key"] == component["vertex"]).groupBy(mention).agg(F.min("component").alias("root"))
    own = mentions.select(mention, normalise(name).alias("_own")).join(rooted, mention, "left")
    root = F.coalesce("root", "_own")
    return own.select(mention, root.alias("root"), F.concat(F.substring(F.sha2(root, 256), 1, 10), F.lit("-"), F.regexp_replace(root, "[^a-z0-9]+", "-")).alias("cluster_id"))


def best_name(names: Column) -> Column:
    """Preferred name of several: a suffix in it, not a development code, fewer words, then the first in order; dose qualifiers are taken off."""
    rank = F.transform(names, lambda n: F.struct((F.size(suffixes_in(n)) == 0).alias("a"), looks_like_dev_code(n).alias("b"), F.size(F.split(F.trim(n), r"\s+")).alias("c"), n.alias("n")))
    return F.trim(F.regexp_replace(F.array_min(rank)["n"], r"(?i)\s*\(?\d+(\.\d+)?\s*(mg|mcg|µg|g)(/(kg|m2|ml))?\)?.*$", ""))


def roll_up(mentions: DataFrame, cluster: str) -> DataFrame:
    """One row for each cluster: sorted synonyms, trials and strategies, date range, sponsors over time, flags, weakest evidence."""
    strength = F.when(F.col("match_strength") == "suffix", 2).when(F.col("match_strength") == "literal", 1).otherwise(0)
    weakest = F.min(F.struct(strength.alias("rank"), F.col("strategy"), F.coalesce("match_term", F.lit("")).alias("term")))
    sponsors = (
        mentions.where("lead_sponsor is not null")
        .groupBy(cluster, "lead_sponsor")
        .agg(F.min(F.struct("study_start_date", "lead_sponsor_class"))["lead_sponsor_class"].alias("class"), F.min("study_start_date").alias("first_seen"), F.max("study_start_date").alias("last_seen"))
        .groupBy(cluster)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("lead_sponsor").alias("sponsor"), "class", "first_seen", "last_seen"))).alias("sponsors_over_time"))
    )
    base = mentions.groupBy(cluster).agg(
        F.sort_array(F.collect_set("intervention_name")).alias("synonyms"), F.sort_array(F.collect_set("nct_id")).alias("nct_ids"), F.sort_array(F.collect_set("strategy")).alias("strategies"),
        F.min("study_start_date").alias("first_trial_start_date"), F.max("study_start_date").alias("last_trial_start_date"),
        F.bool_and(F.coalesce(F.col("match_strength") == "literal", F.lit(False))).alias("ambiguous"), F.bool_and(looks_like_dev_code("intervention_name")).alias("dev_code_only"), weakest.alias("_w"),
    )
    out = base.join(sponsors, cluster, "left").withColumn("proposed_name", best_name(F.col("synonyms"))).withColumn("trial_count", F.size("nct_ids"))
    return out.withColumns({"discovery_strategy": F.col("_w.strategy"), "matched_term": F.nullif(F.col("_w.term"), F.lit(""))}).drop("_w")


def evidence_of(name: Column | str) -> Column:
    """Strength and term by which a name was found (F2)."""
    return match_pattern(name)


def shared_members(members: DataFrame, group: str, member: str, verified: str) -> DataFrame:
    """Members that several groups claim, all of them verified."""
    return members.groupBy(member).agg(F.count_distinct(group).alias("groups"), F.bool_and(verified).alias("ok")).where("groups > 1 and ok").select(member, "groups")


def shared_with(members: DataFrame, group: str, member: str) -> DataFrame:
    """For each member of each group the sorted names of the other groups that claim it.

    The claims on a member are collected once. The output is as long as the claims on each
    member squared: it is for members that few groups claim; ``claims`` has a row for each
    member with all its groups, and their number, instead.
    """
    claims = members.groupBy(member).agg(F.sort_array(F.collect_set(group)).alias("_all"))
    return members.select(group, member).distinct().join(claims, member).select(group, member, F.array_remove("_all", F.col(group)).alias("shared_with"))


def claims(members: DataFrame, group: str, member: str) -> DataFrame:
    """Each member with the sorted groups that claim it and how many those are: what ``shared_with`` says, in linear size."""
    return members.groupBy(member).agg(F.sort_array(F.collect_set(group)).alias("groups")).withColumn("n_groups", F.size("groups"))


def later_successor(rows: DataFrame, key: str, group: list[str], start: str) -> DataFrame:
    """Whether another member of the group starts later: the group's greatest start decides, no pairs.

    A row isn't its own successor; a null start has none.
    """
    tops = rows.groupBy(*group).agg(F.max(start).alias("_top"))
    return rows.join(tops, group, "left").withColumn("has_successor", F.coalesce(F.col("_top") > F.col(start), F.lit(False))).drop("_top")


def unique_match(names: DataFrame, key: str, name: str, dimension: DataFrame, dim_name: str, value: str) -> DataFrame:
    """The value that a record's names, normalised, stand for in a dimension table; several different ones are unresolved."""
    probe = names.select(key, normalise(name).alias("_n")).distinct()
    hits = probe.join(dimension.select(normalise(dim_name).alias("_n"), value).distinct(), "_n")
    found = hits.groupBy(key).agg(F.count_distinct(value).alias("_k"), F.min(value).alias("_v")).select(key, F.when(F.col("_k") == 1, F.col("_v")).alias(value))
    return names.select(key).distinct().join(found, key, "left")


def containment(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """Pairs of names of which one holds the other as whole words, by an equi-join on word runs in either direction."""
    a = left.select(normalise(left_name).alias("a")).distinct()
    b = right.select(normalise(right_name).alias("b")).distinct()

    words = lambda c: F.split(c, r"[^\p{L}\p{N}]+")
    whole_a, whole_b = (df.select(c, F.array_join(words(c), " ").alias("run"), F.size(words(c)).alias("n")).where("run <> ''") for df, c in ((a, "a"), (b, "b")))
    down = _word_runs(a, "a", words("a"), whole_b).join(whole_b.drop("n"), "run").select("a", "b")
    up = _word_runs(b, "b", words("b"), whole_a).join(whole_a.drop("n"), "run").select("a", "b")
    return down.unionByName(up).distinct()


def _word_runs(df: DataFrame, name: str, words: Column, lengths: DataFrame) -> DataFrame:
    """(name, run): the runs of a name's words, of the lengths that occur in ``lengths`` (n): words times lengths, not their square.

    The distinct lengths are one row of integers, at most as long as the longest name has words.
    """
    one = lengths.agg(F.array_sort(F.collect_set("n")).alias("_lengths"))
    fit = F.filter("_lengths", lambda k: k <= F.size("_words"))
    runs = F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), F.size("_words") - k + 1), lambda i: F.array_join(F.slice("_words", i, k), " "))))
    return df.select(name, words.alias("_words")).crossJoin(F.broadcast(one)).select(name, F.explode(F.array_distinct(runs)).alias("run")).where("run <> ''")


def compare_tables(old: DataFrame, new: DataFrame, key: str, name: str) -> DataFrame:
    """(key, change): added, removed, renamed or kept, by a full outer join."""
    j = old.select(key, F.col(name).alias("_old"), F.lit(True).alias("_o")).join(new.select(key, F.col(name).alias("_new"), F.lit(True).alias("_n")), key, "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "renamed").otherwise("kept")
    return j.select(key, change.alias("change"), F.col("_old").alias("old_name"), F.col("_new").alias("new_name"))
