from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairlens.llm import line_rules
from pairlens.llm.common import with_key
from tests.llm.fixtures import documents, no_documents, odd_documents, words


def brute(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    covered = {k for i, x in enumerate(windows) if times[x] > 1 for k in range(i, i + 5)}
    return (
        len(w),
        sum(map(len, w)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


@pytest.mark.parametrize("table", [documents, odd_documents])
def test_measures_agree_with_brute_force(spark, table):
    docs = table(spark)
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    found = line_rules.judge_documents(docs).collect()
    assert Counter((r.doc_id, *[r[c] for c in line_rules.LINE_MEASURES]) for r in found) == want
    for r in found:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def host(spark, n_plain=60):
    """Plain documents, three made of the host's boilerplate, and a page published 200 times."""
    def own(i, k):
        return " ".join(f"d{i}x{k}x{j}" for j in range(12))

    notice = ["please read our terms of use before you go on", "all of this is offered without any warranty"]
    rows = [(i, "\n".join([own(i, 0), notice[0].upper(), own(i, 1), notice[1]]), "h") for i in range(n_plain)]
    rows += [(1000 + i, f"{notice[0]}\n {notice[1]}\nonly{i} left here", "h") for i in range(3)]
    rows += [(2000 + i, "\n".join(own("page", k) for k in range(5)) + (f" edit{i}" if i % 2 else ""), "h") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_depleted_documents_go_and_copies_stay(spark):
    found = {r.doc_id: r for r in line_rules.judge_documents(host(spark)).collect()}
    assert all(found[i].kept and found[i].n_common_lines == 2 for i in range(60))
    assert not any(found[1000 + i].kept for i in range(3))
    assert all(found[2000 + i].kept and found[2000 + i].n_common_lines == 0 for i in range(200))


def test_frequency_counts_texts_but_not_copies(spark):
    measured = line_rules.measure(host(spark))
    found = line_rules.common_lines(measured, 20, 0.005).collect()
    assert len(found) == 2 and all(45 <= r.n_documents <= 63 for r in found)


def test_every_distinct_document_of_a_line_counts(spark):
    found = line_rules.common_lines(line_rules.measure(host(spark)), 20, 0.005).collect()
    assert len(found) == 2 and all(62 <= r.n_documents <= 63 for r in found)


@pytest.mark.parametrize("n_lines", [1, 10])
def test_documents_of_much_boilerplate_count_and_near_copies_do_not(spark, n_lines):
    """Documents of four fifths boilerplate (similarity 0.64), and a page in 400 variants of one word."""
    size = 160 // n_lines
    notice = "\n".join(" ".join(f"n{k}x{j}" for j in range(size)) for k in range(n_lines))
    rows = [(i, notice + "\n" + " ".join(f"d{i}x{j}" for j in range(40)), "h") for i in range(60)]
    page = [f"p{j}" for j in range(120)]
    for i in range(400):
        at = 7 * i % 120
        words = [*page[:at], f"v{i}", *page[at + 1 :]]
        rows.append((1000 + i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, 120, 12)), "h"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_rules.common_lines(line_rules.measure(docs), 20, 0.005).collect()
    assert len(found) == n_lines and all(54 <= r.n_documents <= 60 for r in found)
    verdict = {r.doc_id: r.kept for r in line_rules.judge_documents(docs).collect()}
    assert not any(verdict[i] for i in range(60)) and all(verdict[1000 + i] for i in range(400))


@pytest.mark.parametrize("percent", [70, 80, 85, 90, 95, 98])
@pytest.mark.parametrize("n_lines", [1, 10])
def test_the_more_boilerplate_the_surer_the_verdict(spark, percent, n_lines):
    """60 documents of 200 words: a notice, and a line of their own."""
    size = 2 * percent // n_lines
    notice = "\n".join(" ".join(f"n{k}x{j}" for j in range(size)) for k in range(n_lines))
    rows = [(i, notice + "\n" + " ".join(f"d{i}x{j}" for j in range(200 - 2 * percent)), "h") for i in range(60)]
    verdict = line_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert not any(r.kept for r in verdict) and all(r.n_common_words == size * n_lines for r in verdict)


def judged_by_hand(rows, min_documents, share=0.005):
    """Verdicts from whole window sets: near copies by all pairs, frequencies by sets."""

    def line_of(x):
        return " ".join(words(x)).lower()

    def marks(line):
        w = line.split(" ")
        return {(x, w[i + 1] if i + 1 < len(w) else None) for i, x in enumerate(w)}

    docs = {}
    for host, text in {(r.source, r.text) for r in rows}:
        w = words(text)
        windows = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or tuple(w)
        docs.setdefault((host, windows), []).append([line_of(x) for x in (text or "").split("\n") if words(x)])
    nodes = list(docs)
    near = [
        (i, j) for i, a in enumerate(nodes) for j, b in enumerate(nodes[:i])
        if a[0] == b[0] and isinstance(a[1], frozenset) and isinstance(b[1], frozenset)
        and len(a[1] & b[1]) >= line_rules.NEAR * len(a[1] | b[1])
    ]
    root = {i: i for i in range(len(nodes))}
    for i, j in near:
        old, new = root[i], root[j]
        root = {k: new if v == old else v for k, v in root.items()}
    frequency, totals = {}, {}
    for i, (host, windows) in enumerate(nodes):
        held = {x for lines in docs[host, windows] for x in lines}
        first = next(k for k in root if root[k] == root[i])
        known = {m for x in docs[nodes[first]][0] for m in marks(x)}
        own = frozenset(x for x in held if 2 * len(marks(x) & known) < len(marks(x)))
        kind = (root[i], own if sum(len(x.split(" ")) for x in own) >= 4 else None)
        totals.setdefault(host, set()).add(kind)
        for x in held:
            frequency.setdefault((host, x), set()).add(kind)
    common = {k for k, v in frequency.items() if len(v) > min_documents and len(v) > share * len(totals[k[0]])}
    out = Counter()
    for r in rows:
        n, _, _, _, repeated = brute(r.text)
        failed = n < 10 or 100 * repeated > 20 * n
        hit = sum(len(words(x)) for x in (r.text or "").split("\n") if words(x) and (r.source, line_of(x)) in common)
        left = n - hit
        depleted = hit > 0 and (3 * left < n or (2 * left < n and left < 10))
        out[r.doc_id, hit, not (failed or depleted)] += 1
    return out


@pytest.mark.parametrize("min_documents", [2, 20])
def test_verdict_on_the_real_table_against_brute_force(spark, min_documents):
    docs = documents(spark)
    found = line_rules.judge_documents(docs, min_documents=min_documents).collect()
    want = judged_by_hand(docs.collect(), min_documents)
    assert Counter((r.doc_id, r.n_common_words, r.kept) for r in found) == want


def test_boilerplate_of_a_large_host_is_common(spark):
    """1200 documents of 300 000 are less than 0.5 % of them."""
    held = F.when(F.col("id") < 1200, "\nall rights are reserved here")
    text = F.concat(F.lit("own "), F.col("id").cast("string"), F.coalesce(held, F.lit("")))
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("h").alias("source"))
    found = line_rules.common_lines(line_rules.measure(docs), 20, 0.005).collect()
    assert [r.n_documents for r in found] == [1200]


def test_common_lines_are_removed_from_texts(spark):
    docs = host(spark)
    common = line_rules.common_lines(line_rules.measure(docs), 20, 0.005)
    left = {r.doc_id: r.text for r in line_rules.without_common_lines(docs, common).collect()}
    assert left[1001] == "only1 left here"
    assert left[0].count("\n") == 1 and "terms" not in left[0].lower()


def test_dropping_keeps_rows_and_columns_as_they_are(spark):
    docs = odd_documents(spark)
    kept = line_rules.drop_rejected(docs)
    assert kept.columns == docs.columns
    verdict = Counter((r.doc_id, r.n_words) for r in line_rules.judge_documents(docs).filter("kept").collect())
    assert Counter((r.doc_id, len(words(r.text))) for r in kept.collect()) == verdict


def test_no_rows(spark):
    assert line_rules.judge_documents(no_documents(spark)).count() == 0
    assert line_rules.drop_rejected(no_documents(spark)).count() == 0


def test_plan_is_native(spark):
    plan = line_rules.measure(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keys_tell_null_from_empty(spark):
    rows = spark.createDataFrame([(None, None), (None, ""), (1, None)], "doc_id long, text string")
    assert with_key(rows).select("_llm_id", "_llm_hash").distinct().count() == 3
