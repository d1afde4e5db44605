"""The audit of filters against plain counts, with smaller ids that arrive late and a run that goes on."""

import collections
import itertools
import random
import re

import pytest

from paceline.llm import filter_audit
from paceline.llm.filter_audit import Audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, digest string"
LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    first, marks = {}, collections.defaultdict(lambda: [0, 0])
    for d, t, _, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, q, x in labels:
        marks[d] = [marks[d][0] | (q == 1), marks[d][1] | (x == 1)]
    docs = collections.defaultdict(list)
    for d, t, lang, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        bad = {k for k, f in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t)), strict=True) if f}
        if d is not None and d > first[t]:
            bad.add("E")
        docs[lang or ""].append((bad, *(marks[d] if d is not None else (0, 0))))
    out = {}
    for part, found in docs.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                fails = [x for x in found if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta Gamma DELTA eps#lon".split()) + str(rng.randrange(rng.choice([9, 900]))) for _ in range(rng.choice([20, 99, 100, 150]))) for _ in range(40)]
    texts += [None, "", " \t\x0b\x0c\r\n", "É" * 30, "A" * 9 + "b" * 81, "A" * 10 + "b" * 90, " " + " ".join(f"w{i}" for i in range(100)) + "\n"]
    rows = [(i, rng.choice(texts) if i % 3 else texts[3], rng.choice(["en", "de", None, ""]), str(i)) for i in range(500)]
    rows += [(None, texts[3], "en", "x"), (None, None, None, "x"), (-5, texts[7], "fr", "x"), (-5, texts[7], "de", "x"), (-5, texts[7], "fr", "x"), (-6, texts[8], "en", "x")]
    rows.sort(key=lambda r: -(r[0] if r[0] is not None else 250))  # large ids first: every batch brings smaller ones
    labels = [(i, int(i % 4 == 1), int(i % 7 == 0)) for i in range(0, 500, 2)] + [(4, 1, 0), (6, None, None), (None, 1, 1), (-5, 1, 1)]
    return rows, labels


def as_dict(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def write(spark, rows, path, k):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(path)


def test_late_smaller_ids_and_a_run_that_goes_on(spark, tables, tmp_path):
    rows, labels = tables
    path, work = f"{tmp_path}/docs.parquet", f"{tmp_path}/work"
    marks = spark.createDataFrame(labels, LABELS)
    for k in range(0, 300, 100):
        write(spark, rows[k : k + 100], path, k)
    p = Audit(batches=3, least_buckets=4)
    assert as_dict(filter_audit.audit_files(spark, path, marks, work, p)) == plain(rows[:300], labels)
    write(spark, rows[300:], path, 3)  # taken up by the next run; the first files are not read again
    got = filter_audit.audit_files(spark, path, marks, work, p)
    assert as_dict(got) == plain(rows, labels)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "int"] + ["bigint"] * 7
    changes = spark.read.parquet(f"{work}/changes")
    assert changes.where("n < 0").count() > 3  # masks that smaller ids have taken back
    one = filter_audit.audit_files(spark, path, marks, None, Audit(batches=1))
    assert as_dict(one) == plain(rows, labels)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/d.parquet")
    assert filter_audit.audit_files(spark, f"{tmp_path}/d.parquet", spark.createDataFrame([], LABELS)).count() == 0
