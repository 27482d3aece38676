import re
from collections import Counter, defaultdict

import pytest
from nightjar.llm import line_dedup as L
from nightjar.operators.lineage import Tables, materialize
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def words(line):
    return frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)


def brute(texts, t=0.8):
    """Numbers of the lines that an earlier line matches, for texts in order."""
    seen, sets, holders, out = set(), [], defaultdict(list), []
    for text in texts:
        gone = []
        for i, line in enumerate((text or "").split("\n")):
            s = words(line)
            if not s:
                continue
            common = Counter(j for w in s for j in holders[w])
            if s in seen or any(c >= t * (len(s) + len(sets[j]) - c) - 1e-9 for j, c in common.items()):
                gone.append(i)
            if s not in seen:
                seen.add(s)
                for w in s:
                    holders[w].append(len(sets))
                sets.append(s)
        out.append(gone)
    return out


def run(spark, rows, t=0.8):
    return {r.doc_id: r for r in L.removed_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), t).collect()}


@pytest.mark.parametrize("t", [0.8, 0.9])
def test_against_brute_force(spark, t):
    rows = [(r.doc_id, r.text, r.lang, r.source, "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    got = run(spark, rows, t)
    assert [list(got[r[0]].removed) for r in rows] == brute([r[1] for r in rows], t)


def test_a_large_group_of_near_copies(spark):
    """Variants of a line, many more than the first tries reach, with some that only match a late one."""
    base = [f"w{i}" for i in range(20)]
    lines = []
    for v in range(120):
        line = list(base)
        for k in range(1 + v % 4):
            line[(v * 7 + k * 3) % 20] = f"v{v}x{k}"
        lines.append(" ".join(line))
    rows = [(i, line, None, None, None) for i, line in enumerate(lines)]
    got = run(spark, rows)
    assert [list(got[i].removed) for i in range(120)] == brute(lines)


def test_edge_cases(spark):
    long = " ".join(f"u{i}" for i in range(30_000))
    rows = [(2, "Same line here now.\n\nother", "a", "s", None), (1, "same LINE here now.\n \t", "a", None, None), (3, None, None, None, None), (4, "", None, None, None),
            (5, "a b c\na b c d\na b c d e\na b c d e", None, None, None), (6, long + "\n" + long + " more", None, None, None), (None, "same line here now.", None, None, None), (8, "one\r\none", None, None, None)]
    got = run(spark, rows)
    assert list(got[None].removed) == [] and list(got[1].removed) == [0] and list(got[2].removed) == [0]
    assert (got[3].n_lines, got[4].n_lines, got[3].n_removed) == (0, 1, 0)
    assert list(got[5].removed) == [2, 3] and list(got[6].removed) == [1] and list(got[8].removed) == [1]


def test_rewritten_texts_keep_the_other_columns(spark):
    rows = [(1, "first line of text\n\nshared line of all\n", "en", "a", "q"), (2, "shared line of all\nown line", "en", None, "r"), (2, "shared line of all\nown line", "en", None, "r"),
            (3, None, None, None, None), (4, "shared line of all", "en", "b", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, L.dedup_lines(df).collect()), key=str)
    assert got == sorted([rows[0], (2, "own line", "en", None, "r"), (2, "own line", "en", None, "r"), rows[3], (4, "", "en", "b", "s")], key=str)
    assert L.dedup_lines(df).columns == df.columns


def test_empty_table_and_native_plan(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert L.dedup_lines(none).count() == 0 and L.removed_lines(none).count() == 0
    plan = L.dedup_lines(spark.createDataFrame([(1, "a b c d e", None, None, None)], SCHEMA).cache())._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "ArrowEval" not in plan


def test_the_index_of_prefix_words_is_shuffled_once_in_turns(spark, monkeypatch):
    """Both sides of the join read one exchange, and the turns together find what one turn over all words finds."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(rows + [(1000 + i, text.replace(" of ", " off ") if text else text) for i, text in rows], "doc_id long, text string")
    sets = L._sets(docs, L.word_ranks(docs), 0.8)
    marked = materialize(L._marked(sets, spark.createDataFrame([], "x struct<doc_id: bigint, tp: bigint>")))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):
            spark.conf.set(k, v)
        text = L._candidates(marked, 0, 0.8)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "ReusedExchange" in text and text.count("hashpartitioning(token") == text.count("ReusedExchange") + 1
    pairs = [sorted(map(str, L._candidates(marked, turn, 0.8).collect())) for turn in range(L.TURNS)]
    assert sum(1 for p in pairs if p) > 1
    monkeypatch.setattr(L, "TURNS", 1)
    assert {p for turn in pairs for p in turn} == set(map(str, L._candidates(marked, 0, 0.8).collect()))


def test_the_sets_are_not_shuffled_again_to_be_marked(spark):
    """They lie in buckets by their hash, so only the few settled ones move, and the sets' wide rows stay."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(12)) + "\nsame line for all of them") for i in range(40)]
    docs, tables = spark.createDataFrame(rows, "doc_id long, text string"), Tables(spark)
    sets = tables.write_bucketed(L._sets(docs, L.word_ranks(docs), 0.8), "lines-sets", "a", "b")
    gone = sets.select(F.col("place").alias("x")).limit(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    name = tables.names[id(sets)]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        marked = L._marked(sets, gone)
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert Counter(r.open for r in marked.collect()) == {0: 5, 1: sets.count() - 5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = plan.split("Exchange hashpartitioning")[1:]
    assert all("prefix" not in x.splitlines()[1] for x in moved) and "prefix" in plan
    tables.drop_all()
    assert not spark.catalog.tableExists(name)


def test_odd_blanks_between_words(spark):
    rows = [(1, "a\tb\x0bc d e f g h\r\n\x0c\n  \t"), (2, " A  b c\x0cd e f g\th"), (3, "\t\r"), (4, "x\u00a0y a b c d e f g h"), (5, "x\u00a0y  a b c d e f g h z")]
    got = {r.doc_id: list(r.removed) for r in L.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip((r[0] for r in rows), brute([r[1] for r in rows])))


def test_plans_of_the_verification_hold_no_table_of_ranks(spark, monkeypatch):
    """Plans are written out on the driver, each time that they change; the ranks alone take some 400 KB of text."""
    plans, write = defaultdict(list), Tables.write

    def noted(self, df, label):
        plans[label].append(len(df._jdf.queryExecution().analyzed().toString()))
        return write(self, df, label)

    monkeypatch.setattr(Tables, "write", noted)
    rows = [(i, " ".join(f"w{k}" for k in range(30)) + f" x{i}") for i in range(20)]
    L.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(plans["lines-words"]) >= 2 and max(n for label in plans for n in plans[label]) < 50_000


def test_the_verification_reads_few_texts_of_documents_without_a_candidate(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in [None, *range(2000)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = docs.filter("doc_id is null or doc_id % 100 = 0")
    kept = {r.doc_id for r in L._held(docs, wanted, 21).collect()}
    assert {r.doc_id for r in wanted.collect()} <= kept and len(kept) < 400
    monkeypatch.setattr(L, "MOST_BITS", 6)  # a full bitmap keeps more and loses nothing
    assert {r.doc_id for r in wanted.collect()} <= {r.doc_id for r in L._held(docs, wanted, 21).collect()}
    assert L._held(docs, docs.limit(0), 0).count() == 0
