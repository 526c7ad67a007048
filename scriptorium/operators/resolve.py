"""Entity resolution and the clarification of ambiguous names."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings
from scriptorium.functions import text as T
from scriptorium.operators.matching import maximal_hits, substring_pairs


def unit_armies(chunks: DataFrame) -> DataFrame:
    """``unit_name, armies``: the sorted distinct non-empty armies of each named unit."""
    named = chunks.filter((F.col("unit_name") != "") & (F.col("army") != ""))
    return named.groupBy("unit_name").agg(F.array_sort(F.collect_set("army")).alias("armies"))


def variant_signatures(chunks: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """``unit_name, army, signature`` over the sorted content keys (with repeats) of the unit's categories."""
    rows = chunks.filter(F.col("category").isin(*s.unit_categories)).withColumn("key", T.content_key(F.col("text")))
    return rows.groupBy("unit_name", "army").agg(F.md5(F.array_join(F.array_sort(F.collect_list("key")), "")).alias("signature"))


def chassis_families(units: DataFrame) -> DataFrame:
    """``base, member``: names that are a proper part of others, case aside. ``units``: unit_name."""
    lower = units.select(F.lower("unit_name").alias("l"), F.col("unit_name")).distinct()
    pairs = substring_pairs(lower.select(F.col("l").alias("needle"), F.col("unit_name").alias("base")), lower.select(F.col("l").alias("text"), F.col("unit_name").alias("member")))
    return pairs.filter("needle <> text").select("base", "member").distinct()


def one_per_signature(family: DataFrame, signatures: DataFrame) -> DataFrame:
    """``base, army, member``: of members whose rules are the same in an army the first by name."""
    joined = family.join(signatures.withColumnRenamed("unit_name", "member"), "member")
    by = Window.partitionBy("base", "army", "signature").orderBy("member")
    return joined.withColumn("n", F.row_number().over(by)).filter("n = 1").select("base", "army", "member")


def named_units(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``qid, name``: the names that a question (qid, text) holds, case aside, without those that are part of a longer hit."""
    texts = questions.select("qid", F.lower("text").alias("text"))
    hits = substring_pairs(names.select(F.lower("name").alias("needle")).distinct(), texts)
    return maximal_hits(hits.select("qid", F.col("needle").alias("name")), ["qid"], "name")


def token_owners(names: DataFrame) -> DataFrame:
    """``token, name`` for tokens that one name alone has."""
    pairs = names.select("name", F.explode(F.array_distinct(T.tokens(F.col("name")))).alias("token"))
    return pairs.groupBy("token").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).filter("n = 1").select("token", "name")


def distinctive_tokens(names: DataFrame, core_texts: DataFrame, stopwords: list[str], least: int = 5, most_df: int = 40, core_blocks: int = 3) -> DataFrame:
    """``token``: tokens of names long and rare enough, and not everyday vocabulary of the core texts, as such or as a stem."""
    own = names.select("name", F.explode(F.array_distinct(T.tokens(F.col("name")))).alias("token"))
    rare = own.groupBy("token").agg(F.count_distinct("name").alias("df")).filter((F.length("token") >= least) & (F.col("df") <= most_df) & ~F.col("token").isin(stopwords))
    core = core_texts.select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("blocks")).filter(F.col("blocks") >= core_blocks)
    kept = rare.join(core, "token", "left_anti").withColumn("stem", T.light_stem(F.col("token")))
    stems = core.select(T.light_stem(F.col("token")).alias("stem")).distinct()
    return kept.join(stems, "stem", "left_anti").select("token")


def route(question: Column, faction: Column, names_unit: Column, pack_on: bool, core_phrases: list[str], core_words: list[str], pack_name: str) -> Column:
    """The id of the filter that a question is searched under: by faction, core rules, pack, all. With the pack off no route
    admits its category."""
    q = F.lower(question)
    core = q.contains(pack_name.lower()) | q.rlike(rf"\b(?:{'|'.join(core_words)})\b")
    for phrase in core_phrases:
        core = core | q.contains(phrase)
    known = faction.isNotNull() & (faction != "")
    if pack_on:
        return F.when(known & core, "faction+core+pack").when(known, "faction+pack").when(names_unit, "all").otherwise("core+pack")
    return F.when(known, "faction").when(names_unit, "all-pack").otherwise("core")


def admits(route_id: Column, category: Column, army: Column, faction: Column, s: Settings = SETTINGS) -> Column:
    """Whether a route admits a chunk. A missing category or army is admitted by "not the pack" tests only."""
    pack, core = category.eqNullSafe(F.lit(s.pack_category)), category.eqNullSafe(F.lit(s.core_category))
    mine = army.eqNullSafe(faction) & faction.isNotNull()
    return (
        F.when(route_id == "faction+core+pack", mine | core | pack)
        .when(route_id == "faction+pack", mine | pack)
        .when(route_id == "core+pack", core | pack)
        .when(route_id == "all", F.lit(True))
        .when(route_id == "faction", mine & ~pack)
        .when(route_id == "all-pack", ~pack)
        .when(route_id == "core", core)
        .otherwise(F.lit(False))
    )


def in_scope(category: Column, army: Column, armies: Column, s: Settings = SETTINGS) -> Column:
    """Chunks of units and army rules stay only if one of their comma-separated armies is resolved; others always stay. No
    resolved armies, no restriction."""
    scoped = F.coalesce(category.isin(*s.unit_categories, *s.rule_categories), F.lit(False))
    own = F.transform(F.split(F.coalesce(army, F.lit("")), ","), lambda a: F.trim(a))
    return (F.size(armies) == 0) | ~scoped | F.arrays_overlap(own, armies)


@dataclass(frozen=True)
class Mention:
    """One occurrence of a name. ``family``: for each army the units that may be meant. ``options`` are the armies to ask among;
    ``army`` and ``unit`` are set once settled."""

    ref: str
    start: int | None
    end: int | None
    family: dict[str, tuple[str, ...]]
    options: tuple[str, ...]
    army: str | None = None
    unit: str | None = None
    skipped: bool = False

    @property
    def stage(self) -> str:
        """army, variant or done: what has to be asked next."""
        if self.skipped or self.unit:
            return "done"
        return "variant" if self.army else "army"

    def settle(self, army: str) -> Mention:
        """In an army; its unit too if there is one only."""
        units = self.family[army]
        return replace(self, army=army, unit=units[0] if len(units) == 1 else None)


def decide(options: tuple[str, ...], pinned: str | None, detected: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
    """ask, auto or skip, and the armies left: one if it is settled. Of several armies that the question names, only those are
    asked for."""
    if not options:
        return "skip", ()
    if pinned:
        return ("auto", (pinned,)) if pinned in options else ("skip", ())
    near = tuple(a for a in options if a in detected)
    left = near or options
    return ("auto" if len(left) == 1 else "ask"), left


def clarification_queue(spans: list[tuple[str, int | None, int | None]], families: dict[str, dict[str, tuple[str, ...]]], pinned: str | None, detected: tuple[str, ...]) -> tuple[Mention, ...] | None:
    """The mentions with what is settled already; None if nothing has to be asked or told. ``families``: by name, for each army
    its units whose rules differ."""
    out = []
    for ref, start, end in spans:
        family = families.get(ref, {})
        action, armies = decide(tuple(sorted(family)), pinned, detected)
        mention = Mention(ref, start, end, family, armies, skipped=action == "skip")
        out.append(mention.settle(armies[0]) if action == "auto" else mention)
    return tuple(out) if any(not m.skipped for m in out) else None


def next_question(queue: tuple[Mention, ...]) -> tuple[int, str, tuple[str, ...]] | None:
    """The first open mention with what to ask, an army or one of its units, and the choices."""
    for i, m in enumerate(queue):
        if m.stage != "done":
            return i, m.stage, m.options if m.stage == "army" else m.family[m.army]
    return None


def choose(queue: tuple[Mention, ...], i: int, choice: str | None) -> tuple[Mention, ...]:
    """A new queue with an army or, once that is settled, a unit chosen; None skips the mention."""
    m = queue[i]
    if choice is None:
        new = replace(m, skipped=True)
    elif m.stage == "army" and choice in m.options:
        new = m.settle(choice)
    elif m.stage == "variant" and choice in m.family[m.army]:
        new = replace(m, unit=choice)
    else:
        raise ValueError(f"{choice} is no option of {m.ref}")
    return (*queue[:i], new, *queue[i + 1 :])


def rewrite(question: str, queue: tuple[Mention, ...]) -> str:
    """The question with each settled mention replaced by its unit and army. A mention without a place replaces its first
    occurrence, case aside, or is appended where there is none."""
    placed, rest = [], []
    for m in queue:
        if m.skipped or not m.unit:
            continue
        (placed if m.start is not None else rest).append(m)
    for m in sorted(placed, key=lambda m: -m.start):
        question = f"{question[: m.start]}{m.unit} ({m.army}){question[m.end :]}"
    for m in rest:
        at = question.lower().find(m.ref.lower())
        name = f"{m.unit} ({m.army})"
        question = f"{question} {name}" if at < 0 else f"{question[:at]}{name}{question[at + len(m.ref) :]}"
    return question


def highlight(question: str, ref: str, start: int | None = None, end: int | None = None, mark: str = "**") -> str:
    """The question with a span, or the first occurrence of the name, case aside, between marks."""
    if start is None or end is None:
        start = question.lower().find(ref.lower())
        if start < 0:
            return question
        end = start + len(ref)
    return f"{question[:start]}{mark}{question[start:end]}{mark}{question[end:]}"


def families(chassis: DataFrame, signatures: DataFrame, units: DataFrame) -> DataFrame:
    """``ref, army, members``: for every unit name the units that it may mean in each army, itself included, those of equal rules once.
    ``chassis``: base, member; ``units``: unit_name, army."""
    own = units.select(F.col("unit_name").alias("base"), F.col("unit_name").alias("member")).distinct()
    every = chassis.select("base", "member").unionByName(own).distinct()
    picked = one_per_signature(every, signatures)
    return picked.groupBy(F.col("base").alias("ref"), "army").agg(F.array_sort(F.collect_set("member")).alias("members"))


def names_a_unit(questions: DataFrame, phrases: DataFrame, tokens: DataFrame) -> DataFrame:
    """``qid`` of the questions (qid, text) that hold a name of several words (phrases: name) or a distinctive token (tokens: token)."""
    lower = questions.select("qid", F.lower("text").alias("text"))
    several = phrases.filter(F.size(F.split("name", " ")) > 1).select(F.lower("name").alias("needle")).distinct()
    by_name = substring_pairs(several, lower).select("qid")
    by_token = lower.select("qid", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).join(tokens.select("token").distinct(), "token").select("qid")
    return by_name.unionByName(by_token).distinct()


def faction_words(factions: DataFrame, keywords: DataFrame) -> DataFrame:
    """``word, faction``: names of factions and the faction keywords of their units, lower-cased; of a word given several times the last
    row counts. ``factions``: name, pos; ``keywords``: keyword, faction, pos."""
    rows = factions.select(F.lower("name").alias("word"), F.col("name").alias("faction"), F.lit(0).alias("step"), F.col("pos").cast("bigint"))
    rows = rows.unionByName(keywords.select(F.lower("keyword").alias("word"), "faction", F.lit(1).alias("step"), F.col("pos").cast("bigint")))
    return rows.filter(F.length("word") > 0).groupBy("word").agg(F.max_by("faction", F.struct("step", "pos", "faction")).alias("faction"))
