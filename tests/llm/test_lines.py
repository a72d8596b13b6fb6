import re
from collections import Counter

from marketlens.llm import lines


def brute(rows, gram, window):
    """Runs of lines that occurred before, over (id, text) in order."""
    length, seen, out = gram + window - 1, set(), []
    for i, text in rows:
        split = (text or "").split("\n")
        solid = [n for n, line in enumerate(split) if re.search(r"[^ \t-\r]", line)]
        gone, starts = set(), []
        for k in range(len(solid) - length + 1):
            run = tuple(split[n] for n in solid[k : k + length])
            if run in seen:
                gone |= set(solid[k : k + length])
                starts.append(k)
            seen.add(run)
        runs = sum(1 for a, b in zip([-10 * length, *starts], starts) if b - a > length)
        out.append((i, "\n".join(line for n, line in enumerate(split) if n not in gone), len(split), len(gone), runs))
    return out


def test_brute_force(unique):
    rows = sorted((r["doc_id"], r["text"]) for r in unique.select("doc_id", "text").collect() if r["text"] is not None)
    for gram, window in ((1, 2), (2, 2), (1, 1), (3, 1)):
        got = lines.dedup(unique.filter("text is not null"), gram, window).select("doc_id", "text", "n_lines", "n_removed", "n_runs").collect()
        assert sorted(map(tuple, got)) == brute(rows, gram, window)


def test_odd_cases(odd, empty):
    got = lines.dedup(odd)
    assert [c for c in odd.columns if c != "n_lines"] == got.columns[: len(odd.columns) - 1] and got.columns[-3:] == ["n_lines", "n_removed", "n_runs"]
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in odd.collect())
    same = got.filter("doc_id = 2").select("text").distinct().collect()
    assert len(same) == 1
    assert lines.dedup(empty).count() == 0


def test_no_python(odd):
    plan = lines.dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_alone(rows, alone):
    """As ``brute`` with runs of two lines, long lines and the only lines of documents."""
    seen, out = set(), []
    for i, text in rows:
        split = text.split("\n")
        solid = [n for n, line in enumerate(split) if re.search(r"[^ \t-\r]", line)]
        runs = [(k, k + 1) for k in range(len(solid) - 1)]
        runs += [(k,) for k, n in enumerate(solid) if len(split[n].encode()) > alone or len(solid) == 1]
        gone = set()
        for run in runs:
            lines_of = tuple(split[solid[k]] for k in run)
            if lines_of in seen:
                gone |= set(run)
            seen.add(lines_of)
        lost = {solid[k] for k in gone}
        n_runs = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, "\n".join(line for n, line in enumerate(split) if n not in lost), len(split), len(lost), n_runs))
    return out


def test_long_and_only_lines(spark, unique):
    long = " ".join(f"word{i}" for i in range(60))
    texts = [
        f"a\n{long}\nb", f"c\n{long}\nd\nshort", f"short\n{long}\n{long}", long, "only", "\nonly\n", "short",
        f"x\nshort\ny\n{long}\nx\nshort\ny",
    ]
    rows = list(enumerate(texts))
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), alone=lines.ALONE)
    got = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert {i: r[1] for i, r in got.items()} == {
        0: texts[0], 1: "c\nd\nshort", 2: "short", 3: "", 4: "only", 5: "\n", 6: "short", 7: "x\nshort\ny",
    }
    rows += sorted((r["doc_id"] + 100, r["text"]) for r in unique.collect() if r["text"] is not None)
    for alone in (20, lines.ALONE):
        found = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), alone=alone)
        assert sorted(map(tuple, found.collect())) == brute_alone(rows, alone)
