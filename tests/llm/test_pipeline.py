"""The pipeline stage by stage against brute force, and the registered queries."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from pulsewatch.llm import queries, toxicity
from tests.conftest import SMOKE

from .test_mixing import brute_targets
from .test_pii import luhn
from .test_text_dedup import brute_components, brute_lines, brute_print


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage makes of what its predecessor kept."""
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    # Hard rows beside the real ones: null and empty texts, copies, a null source.
    more = [(10_000, None, "en", "src0", 0), (10_001, "", "en", None, 0), (10_002, "one shared line of text\nthe rest", "en", None, 31),
            (10_003, "one shared line of text\nthe rest", "en", "src1", 31)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("extra", F.lit(1))
    out = [("documents", docs.collect(), docs)]
    for name, stage in P.STAGES:
        df = stage(spark, out[-1][2], SMOKE).checkpoint()
        out.append((name, df.collect(), df))
    return {name: rows for name, rows, _ in out}


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name in list(stages)[1:-1]:
        assert list(stages[name][0].asDict()) == P.COLUMNS


def test_toxic_documents_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMOKE}/labels.parquet").collect()}
    model = queries.toxicity_model(spark, spark.read.parquet(f"{SMOKE}/documents.parquet"), SMOKE)
    want = Counter(r.doc_id for r in stages["documents"] if model.score(r.text) < 0.5)
    assert Counter(r.doc_id for r in stages["toxicity"]) == want
    gone = {r.doc_id for r in stages["documents"]} - set(want)
    assert gone and all(labels.get(i, 1) == 1 for i in gone)


def test_lines_are_cut(stages):
    texts = [(r.doc_id, r.text) for r in stages["toxicity"]]
    assert sorted((r.doc_id, r.text) for r in stages["line_dedup"]) == sorted((i, t) for i, _, _, t in brute_lines(texts))
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"])


def test_one_of_each_group_stays(stages):
    pairs = [(r.doc_id, brute_print(r.text)) for r in stages["line_dedup"]]
    assert sorted(r.doc_id for r in stages["simhash_near_dedup"]) == sorted(set(brute_components(pairs)))


def test_mix_takes_whole_documents_to_target(stages):
    before = stages["simhash_near_dedup"]
    drawn = Counter(r.doc_id for r in stages["mixing"])
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in stages["mixing"]) and max(drawn.values()) <= 2
    size, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        n = len([w for w in r.text.encode().split()])
        size[r.source] += n
        taken[r.source] += n * drawn[r.doc_id]
        most[r.source] = max(most[r.source], n)
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    want = brute_targets([size[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want):
        assert t - most[s] <= taken[s] <= t + 0.5


def test_packing_holds_every_id_of_the_mix(stages):
    from tokenizers import Tokenizer
    tokens = Tokenizer.from_file(queries.tokenizer_path())
    ids = {r.doc_id: np.array([*tokens.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in stages["mixing"]}
    drawn = Counter(r.doc_id for r in stages["mixing"])
    covered = Counter()
    for r in stages["packing"]:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
    assert covered == Counter({i: n * len(ids[i]) for i, n in drawn.items()})
    used = Counter()
    for r in stages["packing"]:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_run_equals_the_stages(spark, stages):
    got = P.run(spark, SMOKE)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0 and P.ORACLE_SQL is None


def test_every_operator_has_a_query():
    names = E.queries()
    assert all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 11)) and "pipeline" in names


def test_queries_return_the_contracts(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    n = docs.count()
    q = E.queries()
    scored = {r.doc_id: r for r in q["op10_toxicity"](spark, SMOKE).collect()}
    assert len(scored) == n
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    pages = q["op9_html"](spark, SMOKE).collect()
    assert len(pages) == spark.read.parquet(f"{SMOKE}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in pages)
    mixed = q["op2_mixing"](spark, SMOKE)
    assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, q["op2_mixing"](spark, SMOKE).collect()))
    private = q["op3_pii"](spark, SMOKE)
    assert private.count() == n
    found = private.filter("n_values > 0").join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect()
    import re
    values = re.compile(r"\S+@mail\d+\.example\.com|\b\d{16}\b|\+1 \(\d{3}\) 555-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b", re.I)
    was = [(v, r.text) for r in found for v in values.findall(r.was)]
    checked = [not re.fullmatch(r"\d{16}", v) or luhn(v[:-1]) == int(v[-1]) for v, _ in was]  # other numbers stay
    assert was and all((v not in t) == valid for (v, t), valid in zip(was, checked))
    licences = q["op4_licenses"](spark, SMOKE).collect()
    assert licences and all(r.n >= 1 for r in licences)


def test_library_without_this_subpackage():
    assert toxicity.__name__.startswith("pulsewatch.llm.")
    import ast
    import pathlib
    root = pathlib.Path(P.__file__).parent / "pulsewatch"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n for n in names), path
