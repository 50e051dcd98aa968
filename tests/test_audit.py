"""Audits at several grains against plain Python."""

import random

from furlong.operators import audit as A
from furlong.operators import repair as R
from furlong.operators import stats as S
from furlong.verify.base import audit_rows

COLUMNS = [*A.FIELDS, "race_number_derived", "race_number_source", "source_page_type"]
SCHEMA = ", ".join(f"{c} {'int' if c == 'race_number_derived' else 'string'}" for c in COLUMNS)


def some_rows(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        r = {c: rng.choice([None, "", " ", "1", "2", "7"]) for c in COLUMNS}
        # a third of all rows in one race, a third without a horse
        r["race_id"] = rng.choice(["r1", "r1", "r2", "r3", "r4", None])
        r["horse_id"] = rng.choice(["h1", "h2 ", None, " ", "h3"])
        r["finish_position"] = rng.choice(["1", "5", "44", "out", "", None])
        r["race_date"] = rng.choice(["20200101", "20300101", None])
        r["odds"] = rng.choice(["1.5", "x", None])
        r["race_number_derived"] = rng.choice([None, 3])
        r["race_number_source"] = rng.choice([None, "", "race_number", "round", "race_no"])
        r["source_page_type"] = rng.choice(["entry", "result", None])
        rows.append(tuple(r[c] for c in COLUMNS))
    return rows


def empty(v):
    return v is None or v.strip(" ") == ""


def kind(f, r):
    if not empty(r[f]):
        return None
    finish = (r["finish_position"] or "").strip()
    if f == "margin" and (finish == "1" or not finish.isdigit()):
        return "domain"
    if f == "result_time" and not finish.isdigit():
        return "domain"
    if f == "finish_position" and (r["source_page_type"] or "").lower() in ("entry", "shutuba"):
        return "domain"
    return "derivable" if f == "race_number" and r["race_number_derived"] is not None else "true"


def key(r):
    return f"{r['race_id'] or ''}:{(r['horse_id'] or '').strip()}"


def test_missingness_at_every_grain(spark):
    rows = [dict(zip(COLUMNS, r)) for r in some_rows(400)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(7)
    got = {r["column"]: r.asDict() for r in A.column_missingness(A.audit_grains(df)).collect()}
    assert sorted(got) == sorted(A.FIELDS)
    for f in A.FIELDS:
        kinds = [kind(f, r) for r in rows]
        g = got[f]
        assert g["total_count"] == 400
        assert (g["domain_allowed_count"], g["derivable_count"], g["true_missing_count"]) == tuple(kinds.count(k) for k in A.KINDS), f
        for name, k in (("example_keys", "true"), ("domain_example_keys", "domain"), ("derivable_example_keys", "derivable")):
            assert g[name] == ",".join(sorted({key(r) for r, x in zip(rows, kinds) if x == k})[:5])
    alias = [r["race_number_source"] for r in rows if not empty(r["race_number"]) and r["race_number_source"] in ("round", "race_no")]
    assert (got["race_number"]["alias_candidate"], got["race_number"]["alias_count"], got["race_number"]["alias_rows"]) == ("race_no,round", 2, len(alias))
    assert got["venue"]["alias_candidate"] == "" and got["venue"]["alias_count"] == 0


def test_checks_against_python(spark):
    rows = [dict(zip(COLUMNS, r)) for r in some_rows(400, seed=9)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    races = spark.createDataFrame([("r1",), ("r1",), ("r2",), ("r3",), ("r4",), ("r5",)], "race_id string")
    grains = A.audit_grains(df, "20200101", "20201231")
    missing = A.column_missingness(grains)
    got = {r["name"]: r["failed_count"] for r in A.consistency_checks(races, grains, missing).collect()}
    horse = lambda r: (r["horse_id"] or "").strip()
    pairs = {(r["race_id"], horse(r)) for r in rows if horse(r)}
    numbers = [(r["race_id"], r["horse_number"]) for r in rows if not empty(r["horse_number"])]
    assert got["race_id_duplicate"] == 1 and got["race_without_horse_data"] == 1
    assert got["horse_id_missing"] == sum(not horse(r) for r in rows)
    assert got["horse_id_duplicate_in_race"] == sum(bool(horse(r)) for r in rows) - len(pairs)
    assert got["horse_number_duplicate_in_race"] == len({x[0] for x in numbers if numbers.count(x) > 1})
    assert got["finish_position_range"] == sum(r["finish_position"] == "44" for r in rows)
    assert got["race_date_out_of_target_period"] == sum(r["race_date"] == "20300101" for r in rows)
    assert got["odds_non_numeric"] == sum(r["odds"] == "x" for r in rows)
    reasons = A.audit_reasons(missing, A.consistency_checks(races, grains, missing), R.priority(missing["column"]))
    found = {(r["reason"], r["column"]): (r["count"], r["priority"], r["example_keys"]) for r in reasons.collect()}
    assert found["alias-candidate", "race_number"] == (2, "Schema review", "race_no,round")
    assert found["consistency:horse_id_missing", "(check)"][:2] == (got["horse_id_missing"], "P0")


def test_rows_without_alias_column_and_empty_table(spark):
    plain = spark.createDataFrame(some_rows(20), SCHEMA).drop("race_number_source")
    assert A.alias_candidates(A.audit_grains(plain)).count() == 0
    grains = A.audit_grains(spark.createDataFrame([], SCHEMA))
    got = A.column_missingness(grains).collect()
    assert len(got) == len(A.FIELDS)
    assert {(r["total_count"], r["missing_rate"], r["severity"]) for r in got} == {(0, None, "pass")}


def test_alias_records_go_to_schema_review(spark):
    df = spark.createDataFrame(some_rows(60), SCHEMA)
    plain, named = R.gap_records(df), R.gap_records(df, A.ALIAS_SOURCES)
    extra = named.exceptAll(plain).collect()
    assert {(r["column"], r["reason"], r["priority"]) for r in extra} == {("race_number", "alias-candidate", "Schema review")}
    want = df.filter(~S.is_missing("race_number") & df["race_number_source"].isin("round", "race_no")).count()
    assert len(extra) == want > 0


def test_decisions_take_one_grouping_of_both_sides(spark, small):
    rows = audit_rows(spark, small).dropDuplicates(["race_id", "horse_id"]).orderBy("race_id", "horse_id")
    kind, first = rows.schema, rows.limit(3).collect()
    nobody = [None if c == "horse_id" else first[0][c] for c in kind.names]
    old = spark.createDataFrame([*first, first[0], nobody], kind)
    new = spark.createDataFrame([*first, nobody], kind)
    got = R.refresh_decisions(old, new, "repair-missing", "2000-06-01 00:00:00")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [race_id") == 1
    seen = {(r["race_id"], r["horse_id"]): r["reason"] for r in got.collect()}
    assert len(seen) == 4 and set(seen.values()) == {"record-hash-same"}


def test_the_loop_over_joined_rows_is_short_enough_for_the_jvm_to_compile(spark, small):
    """HotSpot never compiles methods of more than 8000 bytes."""
    from furlong.verify.base import audit_rows

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = A.counted_grains(audit_rows(spark, small), "19950101", "19991231")
        stages = frame._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < 8000
