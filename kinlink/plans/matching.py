"""The match plan: prepare both sides once, join, score, rank, decide.

Sides are reduced to an ordinal and the processed texts of the rules before
they meet, so the pair stage carries no payload; payloads return by ordinal
for the few candidates kept. Which join makes the candidates depends on the
scope: a category equi-join (through a bridge table when categories are
mapped) shuffles by category or broadcasts the catalog if it is small; only
the GLOBAL scope compares all pairs, and only with a catalog of checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.config import Decision, MatchConfig, Rule, Scope, Side, SourceFilter, require_columns
from kinlink.errors import ConfigError
from kinlink.functions import normalize
from kinlink.functions.matchers import number, pair_score

#: rows of a catalog that every source row may be compared with
MOST_SCAN_TARGETS = 20_000


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _raw(side: Side, columns=F.col) -> list[Column]:
    """Texts of one side before processing."""
    if side.fixed_value is not None:
        return [F.lit(side.fixed_value)]
    if side.combine == "best_of":
        return [columns(c).cast("string") for c in side.columns]
    filled = [_filled(columns(c).cast("string")) for c in side.columns]
    return [_filled(F.concat_ws(side.separator, *filled))] if side.combine == "concat" else [F.coalesce(*filled)]


def _some(texts: list[Column]) -> Column:
    return F.filter(F.array(*texts), lambda x: x.isNotNull() & (x != ""))


def combined(side: Side, columns=F.col) -> Column:
    """Processed texts of one side, as an array of non-empty strings."""
    return _some([normalize.apply(c, side.processors) for c in _raw(side, columns)])


def _mapping_table(mapping) -> Column:
    return normalize.constant_map({str(k): str(v) for k, v in mapping.items()})


def value_mapped(side: Side, mapping, columns=F.col) -> Column:
    """Texts of a source side after value mapping: the processed text, else the raw one, is looked up; what it maps to is processed again; unmapped texts stay."""
    if not mapping:
        return combined(side, columns)
    table, out = _mapping_table(mapping), []
    for c in _raw(side, columns):
        done = normalize.apply(c, side.processors)
        mapped = F.coalesce(F.try_element_at(table, done), F.try_element_at(table, c))
        out.append(F.when(mapped.isNotNull(), normalize.apply(mapped, side.processors)).otherwise(done))
    return _some(out)


def mapping_trace(side: Side, mapping, columns=F.col) -> Column:
    """What value mapping did to a source side: the texts before it, joined by ` / `; whether it changed any; those it does not know."""
    done = [normalize.apply(c, side.processors) for c in _raw(side, columns)]
    before = F.array_join(_some(done), " / ").alias("before")
    if not mapping:
        return F.struct(before, F.lit(False).alias("applied"), F.array().cast("array<string>").alias("unconfigured"))
    table, changed, unknown = _mapping_table(mapping), F.lit(False), []
    for raw, text in zip(_raw(side, columns), done, strict=True):
        mapped = F.coalesce(F.try_element_at(table, text), F.try_element_at(table, raw))
        changed = changed | F.coalesce((text != "") & (mapped != text), F.lit(False))
        unknown.append(F.when(mapped.isNull(), text))
    return F.struct(before, changed.alias("applied"), _some(unknown).alias("unconfigured"))


def source_predicate(f: SourceFilter) -> Column:
    """Null counts as empty text, so `exclude` keeps it; blank values of the list count for nothing."""
    v = normalize.strip(F.coalesce(F.col(f.column).cast("string"), F.lit("")))
    values = [x.strip() for x in f.values if x.strip()]
    if not values:
        hit = F.lit(False)
    elif f.match == "exact":
        hit = v.isin(values)
    else:
        hit = F.lit(False)
        for x in values:
            hit = hit | F.contains(v, F.lit(x))
    return hit if f.mode == "include" else ~hit


def scope_bridge(spark, scope: Scope) -> DataFrame:
    """Distinct (source category, target category) pairs of a MAPPED scope."""
    rows = sorted({(str(k), str(v)) for k, vs in scope.mapping.items() for v in vs})
    return spark.createDataFrame(rows, "scope_s string, scope_t string")


def several(side: Side) -> bool:
    """Whether a side has more than one text."""
    return side.fixed_value is None and side.combine == "best_of" and len(side.columns) > 1


def slim(r: Rule, side: Side, texts: Column) -> Column:
    """What the pair stage needs of a side: its text, or for numeric rules its number, parsed once a row; an array only where a side has several texts."""
    if several(side):
        return F.transform(texts, number) if r.matcher == "numeric" else texts
    one = F.try_element_at(texts, F.lit(1))
    return number(one) if r.matcher == "numeric" else one


def prepare_source(source: DataFrame, config: MatchConfig, ordinal: str) -> DataFrame:
    """s_ord, source_id, scope_s and s_<i>, the source side of every rule."""
    require_columns(source.columns, [*config.source_columns(), ordinal])
    d = source if config.source_filter is None else source.where(source_predicate(config.source_filter))
    own = F.col(ordinal).cast("string")
    ident = F.coalesce(_filled(F.col(config.source_id_column).cast("string")), own) if config.source_id_column else own
    cols = [F.col(ordinal).cast("long").alias("s_ord"), ident.alias("source_id")]
    cols.append((F.col(config.scope.source_column).cast("string") if config.scope.mode != "GLOBAL" else F.lit(None).cast("string")).alias("scope_s"))
    return d.select(*cols, *[slim(r, r.source, value_mapped(r.source, r.value_mapping)).alias(f"s_{i}") for i, r in enumerate(config.rules)])


def prepare_target(target: DataFrame, config: MatchConfig, ordinal: str) -> DataFrame:
    """t_ord, group_code, scope_t and t_<i>, the target side of every rule; rows without code are dropped."""
    require_columns(target.columns, [*config.target_columns(), ordinal])
    code = F.col(config.group_code_column).cast("string")
    d = target.where(code.isNotNull() & (code != ""))
    cols = [F.col(ordinal).cast("long").alias("t_ord"), code.alias("group_code")]
    cols.append((F.col(config.scope.target_column).cast("string") if config.scope.mode != "GLOBAL" else F.lit(None).cast("string")).alias("scope_t"))
    return d.select(*cols, *[slim(r, r.target, combined(r.target)).alias(f"t_{i}") for i, r in enumerate(config.rules)])


def candidate_pairs(s: DataFrame, t: DataFrame, config: MatchConfig, most_targets: int = MOST_SCAN_TARGETS) -> DataFrame:
    """All pairs that the scope allows.

    The slim source is dealt by s_ord first: small files still make many
    tasks, and where the catalog is broadcast the ranking needs no shuffle of
    pairs.
    """
    mode = config.scope.mode
    s = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s_ord")
    if mode == "STRICT":
        return s.join(t, F.col("scope_s") == F.col("scope_t"))
    if mode == "MAPPED":
        return s.join(scope_bridge(s.sparkSession, config.scope), "scope_s").join(t, "scope_t")
    n = t.limit(most_targets + 1).count()
    if n > most_targets:
        raise ConfigError("SCAN_TOO_LARGE", f"more than {most_targets} targets; use a vector retrieval")
    return s.crossJoin(F.broadcast(t))


def best_pair(r: Rule, s: Column, t: Column, semantic: Column | None) -> Column:
    """Best score over the texts of both sides, as `slim` leaves them; null if a side has none. Ties keep the first pair."""
    one = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), pair_score(r.matcher, a, b, r.matcher_options, semantic))
    many_s, many_t = several(r.source), several(r.target)
    if not many_s and not many_t:
        return one(s, t)
    if r.matcher in ("fuzzy", "hybrid"):  # Python functions can't be used inside array expressions
        a = [F.try_element_at(s, F.lit(i + 1)) for i in range(len(r.source.columns))] if many_s else [s]
        b = [F.try_element_at(t, F.lit(i + 1)) for i in range(len(r.target.columns))] if many_t else [t]
        return F.greatest(*[one(x, y) for x in a for y in b])
    a, b = s if many_s else F.array(s), t if many_t else F.array(t)
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: one(x, y)))))


def winning_pair(r: Rule, s: Column, t: Column, semantic: Column | None = None) -> Column:
    """(score, source text, target text) of the best pair over arrays of texts; ties keep the first pair. Null if a side has none."""
    of = lambda texts, side: [F.try_element_at(texts, F.lit(i + 1)) for i in range(len(side.columns) if several(side) else 1)]
    value = number if r.matcher == "numeric" else lambda x: x
    out = []
    for x in of(s, r.source):
        for y in of(t, r.target):
            score = pair_score(r.matcher, value(x), value(y), r.matcher_options, semantic)
            out.append(F.when(x.isNotNull() & y.isNotNull(), F.struct(score.alias("score"), F.lit(-len(out)).alias("place"), x.alias("source"), y.alias("target"))))
    return F.greatest(*out) if len(out) > 1 else out[0]


def score_pairs(pairs: DataFrame, config: MatchConfig, semantic: str | None = None) -> DataFrame:
    """Adds f_<i> (best score of rule i, null: not compared), v_<i> (vetoed), score, vetoed, coverage, compared_fields, critical_conflict, auto_match_safe."""
    sem = F.col(semantic) if semantic else None
    d = pairs.withColumns({f"f_{i}": best_pair(r, F.col(f"s_{i}"), F.col(f"t_{i}"), sem) for i, r in enumerate(config.rules)})
    veto, conflict, fields = F.lit(False), F.lit(False), F.lit(0)
    up, down, all_ = F.lit(0.0), F.lit(0.0), float(sum(r.weight for r in config.rules))
    for i, r in enumerate(config.rules):
        f = F.col(f"f_{i}")
        on = f.isNotNull()
        fields = fields + on.cast("int")
        v = on & (f < float(r.veto_threshold) / 100.0) if r.veto_threshold is not None else F.lit(False)
        veto = veto | v
        if r.critical:
            conflict = conflict | (on & (f <= 0))
        if r.weight:
            up = up + F.when(on & ~v, f * r.weight).otherwise(0.0)
            down = down + F.when(on & ~v, float(r.weight)).otherwise(0.0)
    raw = F.when(F.col("vetoed") | (F.col("w") == 0), 0.0).otherwise(F.col("u") / F.when(F.col("w") == 0, 1.0).otherwise(F.col("w")))
    d = d.withColumns({"vetoed": veto, "critical_conflict": conflict, "compared_fields": fields, "u": up, "w": down})
    d = d.withColumns({"score": F.round(raw * 100, 4), "coverage": F.round(F.col("w") / all_, 6)})
    c = config.decision
    return d.withColumn("auto_match_safe", (F.col("compared_fields") >= c.minimum_compared_fields) & (F.col("coverage") >= c.minimum_weight_coverage) & ~F.col("vetoed")).drop("u", "w")


def with_field_scores(candidates: DataFrame, source: DataFrame, target: DataFrame, config: MatchConfig, source_ordinal: str = "row_ordinal", target_ordinal: str = "row_ordinal") -> DataFrame:
    """Candidates with `field_scores`, per-rule detail of the kept pairs with the texts that scored and the trace of value mapping: texts come back by ordinal for these alone."""
    st = source.select(F.col(source_ordinal).cast("long").alias("s_ord"), *[value_mapped(r.source, r.value_mapping).alias(f"x_{i}") for i, r in enumerate(config.rules)], *[mapping_trace(r.source, r.value_mapping).alias(f"m_{i}") for i, r in enumerate(config.rules)])
    tt = target.select(F.col(target_ordinal).cast("long").alias("t_ord"), *[combined(r.target).alias(f"y_{i}") for i, r in enumerate(config.rules)])
    d = candidates.join(st, "s_ord").join(tt, "t_ord")
    semantic = F.col("semantic") if "semantic" in candidates.columns else None
    d = d.withColumns({f"w_{i}": winning_pair(r, F.col(f"x_{i}"), F.col(f"y_{i}"), semantic) for i, r in enumerate(config.rules)})
    out = []
    for i, r in enumerate(config.rules):
        f, w, m = F.col(f"f_{i}"), F.col(f"w_{i}"), F.col(f"m_{i}")
        v = (f < float(r.veto_threshold) / 100.0) if r.veto_threshold is not None else F.lit(False)
        out.append(
            F.when(
                f.isNotNull(),
                F.struct(
                    F.lit(r.id).alias("rule_id"), F.when(v, 0.0).otherwise(f).alias("score"), F.lit(r.weight).alias("weight"), w["source"].alias("source_value"), w["target"].alias("target_value"), F.lit(r.critical).alias("critical"), (F.lit(r.critical) & (f <= 0)).alias("conflict"), v.alias("vetoed"), f.alias("score_before_veto"),
                    m["before"].alias("source_value_before_mapping"), m["applied"].alias("value_mapping_applied"), m["unconfigured"].alias("unconfigured_source_values"),
                ),
            )
        )
    return d.withColumn("field_scores", F.filter(F.array(*out), lambda x: x.isNotNull())).drop(*[f"{c}_{i}" for c in "xymw" for i in range(len(config.rules))])


def rank_candidates(scored: DataFrame, top_n: int) -> DataFrame:
    """The best top_n candidates of each source row by score, ties in catalog order; adds rank."""
    w = Window.partitionBy("s_ord").orderBy(F.col("score").desc(), F.col("t_ord").asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def decide(top1: Column, d: Decision) -> Column:
    out = F.when(top1 >= d.success_threshold, "MATCHED")
    if d.review_enabled:
        out = out.when(top1 > 0, "REVIEW")
    return out.otherwise("UNMATCHED")


def items(source: DataFrame, ranked: DataFrame, config: MatchConfig) -> DataFrame:
    """One row per prepared source row: status, top-1 and second score, gap, conflict, final code."""
    best = ranked.groupBy("s_ord").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
        F.max(F.when(F.col("rank") == 1, F.col("group_code"))).alias("top1_group_code"),
        F.bool_or(F.when(F.col("rank") == 1, F.col("critical_conflict"))).alias("critical_conflict"),
    )
    d = source.select("s_ord", "source_id").join(best, "s_ord", "left")
    d = d.withColumn("status", decide(F.coalesce("top1_score", F.lit(0.0)), config.decision))
    return d.withColumns(
        {
            "score_gap": F.when(F.col("top1_score").isNotNull(), F.round(F.col("top1_score") - F.coalesce("second_score", F.lit(0.0)), 4)),
            "critical_conflict": F.coalesce("critical_conflict", F.lit(False)),
            "final_group_code": F.when(F.col("status") == "MATCHED", F.col("top1_group_code")),
        }
    )


def _alike(s: DataFrame, least: float = 2.0) -> tuple[DataFrame, DataFrame | None]:
    """Prepared source rows that differ in what the rules see, and (s_ord, first) of all rows: the first of those that are alike.

    Rows alike in scope and texts have the same candidates, so each kind is
    paired once. Where there are few such rows (by an approximate count, less
    than `least` a kind) all are paired, and there is no second table.
    """
    keys = [c for c in s.columns if c not in ("s_ord", "source_id")]
    n = s.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.struct(*keys)).alias("kinds")).first()
    if n["rows"] < least * n["kinds"]:
        return s, None
    kinds = s.groupBy(*keys).agg(F.min("s_ord").alias("first"))
    same = None
    for k in keys:
        c = s[k].eqNullSafe(kinds[k])
        same = c if same is None else same & c
    return kinds.withColumnRenamed("first", "s_ord").withColumn("source_id", F.lit(None).cast("string")), s.join(kinds, same).select(s["s_ord"], "first")


def match(source: DataFrame, target: DataFrame, config: MatchConfig, source_ordinal: str = "row_ordinal", target_ordinal: str = "row_ordinal"):
    """(items, candidates) of a scan match; both lazily planned. with_field_scores adds the detail of candidates."""
    if any(r.semantic for r in config.rules):
        raise ConfigError("SEMANTIC_PROVIDER_NOT_READY", "semantic rules need match_with_vectors")
    s, t = prepare_source(source, config, source_ordinal), prepare_target(target, config, target_ordinal)
    kinds, members = _alike(s)
    ranked = rank_candidates(score_pairs(candidate_pairs(kinds, t, config), config).select(*_kept(config)), config.decision.top_n)
    if members is not None:
        ranked = members.join(ranked.withColumnRenamed("s_ord", "first"), "first").drop("first")
    return items(s, ranked, config), ranked


def _kept(config: MatchConfig, *more: str) -> list[str]:
    return ["s_ord", "t_ord", "group_code", "score", *more, "vetoed", "coverage", "compared_fields", "critical_conflict", "auto_match_safe", *[f"f_{i}" for i in range(len(config.rules))]]


def match_with_vectors(source: DataFrame, target: DataFrame, config: MatchConfig, hits: DataFrame, source_ordinal: str = "row_ordinal", target_ordinal: str = "row_ordinal"):
    """(items, candidates) over retrieved pairs: hits has s_ord, t_ord, similarity."""
    s, t = prepare_source(source, config, source_ordinal), prepare_target(target, config, target_ordinal)
    h = hits.select("s_ord", "t_ord", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity").cast("double"))).alias("semantic"))
    pairs = h.join(s, "s_ord").join(t, "t_ord")
    if config.scope.mode == "STRICT":
        pairs = pairs.where("scope_s = scope_t")
    elif config.scope.mode == "MAPPED":
        pairs = pairs.join(scope_bridge(source.sparkSession, config.scope), ["scope_s", "scope_t"], "left_semi")
    ranked = rank_candidates(score_pairs(pairs, config, "semantic").select(*_kept(config, "semantic")), config.decision.top_n)
    return items(s, ranked, config), ranked


def retrieval_text(rules: list[Rule] | tuple[Rule, ...], role: str) -> Column:
    """Distinct texts of the weighted rules, in order, joined by a blank."""
    parts = [value_mapped(r.source, r.value_mapping) if role == "source" else combined(r.target) for r in rules if r.weight > 0]
    return F.array_join(F.array_distinct(F.flatten(F.array(*parts))), " ")


def side_text(config: MatchConfig, role: str) -> Column:
    """Retrieval text of a side: its own definition, or the texts of the weighted rules."""
    own = getattr(config.retrieval, role)
    if own is not None:
        return F.array_join(F.array_distinct(combined(own)), " ")
    return retrieval_text(config.rules, role)


def use_vectors(mode: str, n_targets: int, semantic: bool, most_scan: int = MOST_SCAN_TARGETS) -> bool:
    """Path router: semantic rules and catalogs beyond the scan limit need retrieval."""
    if mode == "scan":
        return False
    return mode == "vector" or semantic or n_targets > most_scan


def match_auto(source: DataFrame, target: DataFrame, config: MatchConfig, embed, dim: int, source_ordinal: str = "row_ordinal", target_ordinal: str = "row_ordinal", most_scan: int = MOST_SCAN_TARGETS, ann_least: int | None = None):
    """(items, candidates) by the path the configuration and the catalog ask for.

    embed: a function from a text column to a vector column. A scan limited to
    a category (scope) needs no limit on the catalog; retrieval takes the
    config's top_k, by sign hashes where the catalog is large.
    """
    from kinlink.operators import retrieval

    semantic = any(r.semantic for r in config.rules)
    n = 0 if config.scope.mode != "GLOBAL" or config.retrieval.mode != "auto" else target.limit(most_scan + 1).count()
    if not use_vectors(config.retrieval.mode, n, semantic, most_scan):
        return match(source, target, config, source_ordinal, target_ordinal)
    code = F.coalesce(F.col(config.group_code_column).cast("string"), F.lit(""))
    rows = lambda df, role, ordinal: df.select(F.col(ordinal).cast("long").alias("id"), side_text(config, role).alias("text")).where("text <> ''").select("id", embed(F.col("text")).alias("vector"))
    queries = source if config.source_filter is None else source.where(source_predicate(config.source_filter))
    hits = retrieval.retrieve(rows(queries, "source", source_ordinal), rows(target.where(code != ""), "target", target_ordinal), config.retrieval.top_k, dim, config.retrieval.oversample, *([ann_least] if ann_least else []))
    return match_with_vectors(source, target, config, hits.select(F.col("q_id").alias("s_ord"), F.col("t_id").alias("t_ord"), "similarity"), source_ordinal, target_ordinal)
