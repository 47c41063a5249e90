"""Containment join and theme operators against plain loops."""

from __future__ import annotations

import json
import random

from tickloom.operators import themes as H
from tickloom.operators.containment import contained


def test_contained_matches_loops(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab中é😀 ") for _ in range(n))
    patterns = [word(rng.choice([1, 2, 3, 5, 6, 9])) for _ in range(150)] + ["", None, "aab" * 30]
    texts = [(i, word(rng.randrange(0, 60))) for i in range(80)] + [(80, None), (81, ""), (82, "aab" * 5_000), (82, "é")]
    got = contained(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame(texts, "tid int, text string")).collect()
    want = {(p, i) for p in patterns if p for i, t in texts if t and p in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def frame(spark, rows):
    return spark.createDataFrame(rows, "theme string, ord long, keywords array<string>, capital_signal string, evidence string")


def test_named_stocks(spark):
    t = frame(spark, [("算力", 1, [], "甲公司 放量", None), ("机器人", 2, None, "", "甲公司、乙科技和ab"), ("空", 3, [], None, None), ("算力", 4, [], "甲公司", "")])
    names = spark.createDataFrame([("1", "甲公司"), ("2", "乙科技"), ("3", "ab"), ("4", " 丙股份 "), ("5", None)], "ts_code string, name string")
    assert {r.ts_code: r.themes for r in H.named_stocks(t, names).collect()} == {"1": ["算力", "机器人"], "2": ["机器人"]}


PROFILES = [("1", "甲", "芯片设计", "算力 服务器", "算力 机房", "餐饮"), ("2", "乙", "餐饮", "餐饮", "机器人 减速器", "电机"), ("3", "丙", "银行", None, None, None)]
COLUMNS = "ts_code string, name string, industry string, main_business string, introduction string, business_scope string"


def test_token_matches_keep_the_first_two(spark):
    t = frame(spark, [("算力", 1, ["服务器"], "", ""), ("芯片", 2, ["设计"], "", ""), ("机房", 3, ["行业"], "", ""), ("机器人", 4, ["减速器"], "", ""), ("行业", 5, [], "", "")])
    c = spark.createDataFrame([(*p, ["旧"] if p[0] == "3" else []) for p in PROFILES], COLUMNS + ", matched_themes array<string>")
    assert {r.ts_code: r.matched_themes for r in H.heuristic_match(t, c).collect()} == {"1": ["算力", "芯片"], "2": ["机器人"], "3": ["旧"]}
    assert {r.ts_code: r.matched_themes for r in H.industry_match(t, c).collect()} == {"1": ["芯片"], "2": [], "3": ["旧"]}


def test_checked_picks_and_merge(spark):
    t = frame(spark, [("算力", 1, ["服务器"], "", ""), ("机器人", 2, ["减速器"], "", ""), ("电机", 3, ["减速器"], "", ""), ("餐饮", 4, [], "", ""), ("行业", 5, [], "", "")])
    p = spark.createDataFrame(PROFILES, COLUMNS)
    picks = spark.createDataFrame([("1", 0, "算力"), ("1", 1, "餐饮"), ("2", 0, "机器人"), ("2", 1, "电机"), ("3", 0, "算力"), ("2", 2, "行业"), ("9", 0, "算力")], "ts_code string, pos int, theme string")
    out = lambda **k: {(r.ts_code, r.theme) for r in H.checked_picks(picks, t, p, **k).collect()}
    strict = {("1", "算力"), ("2", "机器人"), ("9", "算力")}
    assert out() == strict and out(relaxed=True) == strict | {("2", "电机")}
    named = spark.createDataFrame([("3", ["餐饮", "算力"])], "ts_code string, themes array<string>")
    assert out(relaxed=True, named=named) == strict | {("2", "电机"), ("3", "算力")}
    rows = H.merged(p, H.checked_picks(picks, t, p, named, relaxed=True), named).collect()
    assert {r.ts_code: (r.matched_themes, r.off_theme) for r in rows} == {"1": (["算力"], False), "2": (["机器人", "电机"], False), "3": (["算力", "餐饮"], False)}


def test_answers_in_all_forms(spark):
    t = frame(spark, [("AI算力", 1, [], "", ""), ("机器人", 2, [], "", ""), ("芯片", 3, [], "", "")])
    contents = {
        1: json.dumps({"matches": {"a": ["AI 算力", "无此题材"], "b": [], "zz": ["芯片"]}, "notes": {"b": "芯片"}}, ensure_ascii=False),  # asked form: notes aren't read
        2: "```json\n" + json.dumps({"matches": {"机 器人": ["a", "b"], "不明": ["a"]}, "notes": {}}, ensure_ascii=False) + "\n```",
        3: json.dumps({"matches": {"ts_code": ["a", "other"]}, "notes": {"a": "属于 AI 算力 与 芯片", "x": "芯片"}}, ensure_ascii=False),
        4: json.dumps({"matches": {"theme": ["芯片"]}, "notes": {"a": "芯片"}}, ensure_ascii=False),  # a theme under no code: notes aren't read
        5: '{"matches": {"a": ["芯片"', 6: "", 7: None, 8: json.dumps({"matches": {"a": "芯片", "b": ["芯片", "芯片"]}}, ensure_ascii=False), 9: "[1]",
    }
    answers = spark.createDataFrame(list(contents.items()), "batch long, content string")
    items = spark.createDataFrame([(b, c) for b in contents for c in "ab"], "batch long, ts_code string")
    picks, damaged = H.decoded_answers(answers, items, t)
    got = sorted((r.batch, r.ts_code, r.pos, r.theme) for r in picks.collect())
    assert got == [(1, "a", 0, "AI算力"), (2, "a", 2, "机器人"), (2, "b", 2, "机器人"), (3, "a", 1, "AI算力"), (3, "a", 3, "芯片"), (8, "b", 0, "芯片"), (8, "b", 1, "芯片")]
    assert sorted(r.batch for r in damaged.collect()) == [5, 6, 7, 9]


def test_verdict_keeps_the_evidence_that_decided(spark):
    """First veto over all, then the last severe event, then the model's word, softened by findings; sources of the trigger alone or primary ones first."""
    from tickloom.operators import evidence as V

    rows = [("a", 1, "u1", None, True, True), ("a", 2, "u2", "delisting_risk", False, False), ("a", 3, "u3", "material_reduction", False, False),
            ("b", 4, "u4", None, True, False), ("b", 5, "u5", None, True, False), ("c", 6, "u6", None, False, True), ("c", 7, "http://www.sse.com.cn/x", None, False, False),
            ("d", 8, "u8", None, False, False), ("d", 9, "u9", None, False, True), ("d", 10, "u8", None, False, False), ("d", 11, "u11", None, False, False), ("d", 12, "u12", None, False, False)]
    hits = spark.createDataFrame(rows, "ts_code string, doc_id long, url string, veto string, severe boolean, minor boolean")
    soft = spark.createDataFrame([("a", "pass"), ("b", "warn"), ("c", "fail"), ("d", "fail"), ("e", "pass")], "ts_code string, verdict string")
    found = spark.createDataFrame([("c", 1, 0, ["f1", "f2", "f3"]), ("d", 0, 1, None)], "ts_code string, findings int, snippets int, links array<string>")
    got = {r.ts_code: (r.verdict, r.reason, r.noted, r.sources) for r in V.merged_verdicts(hits, soft, found).collect()}
    assert got == {"a": ("fail", "delisting_risk", False, ["u2"]), "b": ("fail", "severe_regulatory", False, ["u5"]),
                   "c": ("warn", None, True, ["http://www.sse.com.cn/x", "f1", "f2"]), "d": ("fail", None, False, ["u8", "u9", "u11"]), "e": ("pass", None, False, [])}


def test_refill_rounds_leave_out_what_was_audited(spark):
    from tickloom.operators import selection as U

    rows = [(f"{i:02d}", float(i), float(i % 7), 20.0 + i, 0.2 if i % 2 else 0.9) for i in range(40)]
    u = spark.createDataFrame(rows, "ts_code string, pre_audit double, composite_score double, consolidation_score double, volume_boost double")
    matched = spark.createDataFrame([("01", ["t"]), ("02", ["t"]), ("03", ["t"])], "ts_code string, matched_themes array<string>")
    themes = spark.createDataFrame([("t", "confirmed", False)], "theme string, status string, capital_signal boolean")
    named = spark.createDataFrame([("01",)], "ts_code string")
    one = U.round_candidates(u, matched, named, themes, 0).collect()
    assert {r.ts_code for r in one if r.list_type == "theme_driven"} == {"01", "02"}  # 01 is named, 03 trades too little
    assert [r.ts_code for r in sorted(one, key=lambda r: -r.pre_audit) if r.list_type == "technical"] == [f"{i:02d}" for i in range(39, 29, -1)]
    enough = spark.createDataFrame([(f"{i:02d}",) for i in range(30, 36)], "ts_code string")
    assert U.refilled(u, matched, named, themes, enough).agg({"round": "max"}).first()[0] == 0
    few = U.refilled(u, matched, named, themes, enough.limit(1)).collect()
    assert {r.round for r in few} == {0, 1, 2}
    tech = [r.ts_code for r in few if r.list_type == "technical"]
    assert len(tech) == len(set(tech)) and {r.filter_tier for r in few if r.list_type == "technical"} == {"technical"}
    none = U.round_candidates(u, matched.limit(0), named.limit(0), themes, 0).collect()
    assert {r.filter_tier for r in none} == {"OFF_THEME_FALLBACK"}


def test_texts_send_on_only_what_looks_like_an_anchor(spark, tmp_path):
    """The join by runs gets the places of anchors, not every run of a text; long patterns, names at both ends and shared anchors are found."""
    patterns = [f"Supplier#{i:09d}" for i in range(300)] + ["长" * 70, "é😀", "x"]
    texts = [(i, f"Supplier#{i:09d} " + "the quick brown fox " * 50 + f"Supplier#{i * 7 % 400:09d}") for i in range(100)] + [(100, "长" * 75), (101, "aé😀b")]
    t = spark.createDataFrame(texts, "tid int, text string")
    out = contained(spark.createDataFrame([(p,) for p in patterns], "pattern string"), t)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, i) for p in patterns for i, s in texts if p in s}
    out = contained(spark.createDataFrame([(p,) for p in patterns[:300]], "pattern string"), t)
    plan = out._jdf.queryExecution().executedPlan()
    out.collect()
    made = exploded(plan)
    assert made and max(made) < 5_000  # the texts have 100,000 characters


def exploded(node) -> list[int]:
    """Rows made by each explode of an executed plan."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exploded(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exploded(node.plan())
    own = [node.metrics().apply("numOutputRows").value()] if kind == "GenerateExec" else []
    return own + [n for i in range(node.children().size()) for n in exploded(node.children().apply(i))]
