import csv
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.functions.prompts import REQUIRED_KEYS, TEMPLATES, check_template
from causeway.operators import filters
from causeway.plans import evaluate
from causeway.sources import corpora, readers, rules, sinks
from causeway.sources.rules import CHAIN, SEQUENCE, SPAN

HEADER = ["corpus", "doc_id", "sent_id", "eg_id", "index", "text", "text_w_pairs", "seq_label", "pair_label", "context", "num_sents"]


def pair(corpus, doc, sent, eg, cause, effect, cue="because", label=1, sents=1, both=None):
    text = both or f"{effect} {cue} {cause}"
    marked = text.replace(cause, f"<ARG0>{cause}</ARG0>", 1).replace(effect, f"<ARG1>{effect}</ARG1>", 1)
    return [corpus, doc, sent, eg, f"{doc}_{sent}_{eg}", text, marked, label, label, "", sents]


def write_pairs(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(HEADER)
        writer.writerows(rows)


def pdtb_rows():
    rows = []
    for i in range(40):
        doc = "wsj_00%02d" % i if i < 8 else "wsj_05%02d" % i
        cue = "because" if i % 2 else "while"
        rows.append(pair("pdtb", doc, i, 0, f"it, \"rained\" {i}", f"we stayed {i}", cue, sents=1 + i % 2))
    both = "ax because bx\nand ux while vx"
    rows.append(pair("pdtb", "wsj_0090", 99, 0, "bx", "ax", both=both))
    rows.append(pair("pdtb", "wsj_0090", 99, 1, "vx", "ux", both=both))
    rows.append(pair("pdtb", "wsj_0091", 1, 0, "x", "y", label=0))
    return rows


@pytest.fixture(scope="module")
def data_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpora")
    write_pairs(root / "pdtb.csv", pdtb_rows())
    rows = [[r[0].replace("pdtb", "because"), *r[1:]] for r in pdtb_rows()]
    rows.append(pair("because", "Article247_327.ann", 5, 0, "heat", "sweat"))
    write_pairs(root / "because.csv", rows)
    for name in ("altlex", "ctb", "esl2", "semeval2010t8"):
        some = [pair(name, f"d{i}", i, 0, f"c{i}", f"e{i}", label=i % 2, sents=1 + i % 3) for i in range(30)]
        write_pairs(root / f"{name}_train.csv", some[:24])
        write_pairs(root / f"{name}_test.csv", some[24:])
    for part, count in (("", 30), ("2", 31)):
        with open(root / f"fnp2020-fincausal{part}-task1.csv", "w") as out:
            out.write("Index; Text; Gold\n")
            for i in range(count):
                out.write(f'{i:04d}.0; The "{i}" rose. It fell {i % 3}.; {i % 2}\n')
            out.write("9999; ; 0\n")
        with open(root / f"fnp2020-fincausal{part}-task2.csv", "w") as out:
            out.write("Index; Text; Cause; Effect; Sentence\n")
            for i in range(count):
                tagged = f"<e2>Sales{part} fell {i}</e2> because <e1>rain came</e1>"
                out.write(f"{i}; Sales{part} fell {i} because rain came; rain came; Sales{part} fell {i}; {tagged}\n")
            out.write("77; twice; a; b; c\n78; twice; a; b; c\n")
    for name, prefix in (("kessan_data_for_classify", "k"), ("nikkei_data", "n")):
        with open(root / f"{name}.tsv", "w") as out:
            out.write("flag\tid\tsentence\n")
            for i in range(20):
                out.write(f"{i % 2}\t{prefix}{i}\t売上{i}が伸びた\n")
    (root / "kessan").mkdir()
    sentences = [
        "<c1>ため</c1><b1>雨</b1>で<r1>遅れ</r1>た",
        "<b1>雨</b1><r1>雪</r1><b2>風</b2><r2>雲</r2>",
        "<b1>雨<r1>雪</r1></b1><b2>風</b2><r2>雲</r2>",
    ]
    for name in ("train", "dev", "test"):
        with open(root / "kessan" / f"{name}.jsonl", "w", encoding="utf-8") as out:
            for sentence in sentences:
                out.write(json.dumps({"tagged_sentence": sentence, "other": 1}, ensure_ascii=False) + "\n")
    (root / "reco").mkdir()
    for name in ("train", "dev", "test"):
        instances = [
            {"index": f"{name}1", "events": ["a_x", "b", "c", "d"], "short_contexts": ["1", "2", "3"], "label": 2},
            {"index": f"{name}2", "events": ["a", "b", "c"], "short_contexts": ["1", "2"], "label": 1},
        ]
        with open(root / "reco" / f"{name}.json", "w") as out:
            json.dump({"instances": instances}, out, indent=1)
    return str(root)


def sizes(frame):
    counts = {r.split: r["count"] for r in frame.groupBy("split").count().collect()}
    return tuple(counts.get(s, 0) for s in ("train", "valid", "test"))


@pytest.mark.parametrize(
    "corpus, task, options, expected",
    [
        ("pdtb", SEQUENCE, {}, (24, 8, 10)),
        ("pdtb", SEQUENCE, {"num_sent": "intra"}, (26, 6, 6)),
        ("pdtb", SEQUENCE, {"plicit": "explicit"}, (24, 8, 10)),
        ("pdtb", SPAN, {}, (26, 6, 9)),
        ("pdtb", SPAN, {"num_causal": "single"}, (26, 6, 8)),
        ("pdtb", SPAN, {"num_causal": "multi"}, (31, 1, 1)),
        ("pdtb", SPAN, {"num_causal": "single", "plicit": "explicit"}, (28, 4, 4)),
        ("pdtb", SPAN, {"num_causal": "single", "plicit": "implicit"}, (28, 4, 4)),
        ("because", SEQUENCE, {}, (26, 6, 11)),
        ("ctb", SEQUENCE, {}, (20, 4, 6)),
        ("ctb", SEQUENCE, {"num_sent": "inter"}, (20, 4, 4)),
        ("esl", SEQUENCE, {"num_sent": "intra"}, (22, 2, 2)),
        ("semeval", SEQUENCE, {}, (20, 4, 6)),
        ("altlex", SPAN, {}, (10, 2, 3)),
        ("fincausal", SEQUENCE, {}, (24, 3, 4)),
        ("fincausal", SEQUENCE, {"num_sent": "intra"}, (24, 3, 0)),
        ("fincausal", SPAN, {}, (48, 6, 7)),
        ("fincausal", SPAN, {"plicit": "explicit"}, (48, 6, 7)),
        ("jpfinresults", SEQUENCE, {}, (16, 2, 2)),
        ("jpnikkei", SEQUENCE, {}, (16, 2, 2)),
        ("jpfinresults", SPAN, {}, (2, 2, 2)),
        ("jpfinresults", SPAN, {"num_causal": "multi"}, (2, 2, 1)),
        ("reco", CHAIN, {}, (2, 2, 2)),
    ],
)
def test_load_sizes(spark, data_dir, corpus, task, options, expected):
    rows = corpora.load_corpus(spark, corpus, task, data_dir, **options)
    assert rows.columns == [*filters.TASK_COLUMNS[task], "split"]
    got = sizes(rows)
    if corpus == "pdtb" and task == SEQUENCE:
        # Test rows with a relation number above 0 do not count.
        assert got[2] == expected[2] and sum(got[:2]) == 32
    else:
        assert got == expected


@pytest.mark.parametrize(
    "corpus, task, options",
    [
        ("reco", SPAN, {}),
        ("ctb", SPAN, {}),
        ("altlex", SEQUENCE, {"num_sent": "inter"}),
        ("jpnikkei", SEQUENCE, {"plicit": "explicit"}),
    ],
)
def test_load_refuses(spark, data_dir, corpus, task, options):
    with pytest.raises(ValueError):
        corpora.load_corpus(spark, corpus, task, data_dir, **options)


def test_load_all(spark, data_dir):
    parts = [sizes(corpora.load_corpus(spark, c, SEQUENCE, data_dir)) for c in corpora.ALL_CORPORA[SEQUENCE]]
    rows = corpora.load_corpus(spark, "all", SEQUENCE, data_dir)
    assert sizes(rows) == tuple(map(sum, zip(*parts)))
    assert dict(rows.dtypes)["example_id"] == "bigint"


def test_load_content(spark, data_dir):
    rows = {r.text: r for r in corpora.load_corpus(spark, "fincausal", SPAN, data_dir).collect()}
    row = rows["Sales2 fell 3 because rain came"]
    assert row.example_id == "fincausal2_3"
    assert row.tags == ["B-E", "I-E", "I-E", "O", "B-C", "I-C"]
    assert row.tagged_text == "<e>Sales2 fell 3</e> because <c>rain came</c>"
    rows = corpora.load_corpus(spark, "jpfinresults", SPAN, data_dir).where("split = 'test'").collect()
    by_id = {r.example_id: r for r in rows}
    assert set(by_id) == {"kessan_test_0", "kessan_test_1"}
    assert by_id["kessan_test_0"].tagged_text == "ため<c>雨</c>で<e>遅れ</e>た"
    assert by_id["kessan_test_0"].tags == ["O", "O", "B-C", "O", "B-E", "I-E", "O"]
    pairs = corpora.load_corpus(spark, "pdtb", SPAN, data_dir).where("split = 'test'").collect()
    merged = [r.tagged_text for r in pairs if "<c2>" in r.tagged_text]
    assert merged == ["<e1>ax</e1> because <c1>bx</c1>\nand <e2>ux</e2> while <c2>vx</c2>"]


def test_tokenizer_may_be_a_pandas_udf(spark, data_dir):
    @F.pandas_udf("array<string>")
    def two_by_two(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [t[i : i + 2] for i in range(0, len(t), 2)])

    rows = corpora.load_corpus(spark, "jpfinresults", SPAN, data_dir, tokenizer=two_by_two)
    row = rows.where("example_id = 'kessan_train_0'").first()
    assert row.tokens == ["ため", "雨で", "遅れ", "た"]
    # A cause tag that ends inside a token is found one token late.
    assert row.tags == ["O", "B-C", "I-C", "I-C"]


def test_cross_corpus_and_samples(spark, data_dir):
    rows = corpora.load_data(spark, SEQUENCE, "ctb", data_dir, test_corpus="fincausal", test_samples=2)
    assert sizes(rows) == (20, 4, 2)
    assert all(r.example_id.startswith("fincausal") for r in rows.where("split = 'test'").collect())
    assert sizes(corpora.load_data(spark, SEQUENCE, "ctb", data_dir, test_samples=100)) == (20, 4, 6)


def test_ordinals_across_files(spark, tmp_path):
    for name, lines in (("b", ["3", "4"]), ("a", ["0", "1", "2"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    rows = readers.with_ordinal(spark.read.schema("v bigint").csv(str(tmp_path))).collect()
    assert all(r.v == r.ordinal for r in rows) and len(rows) == 5


def test_rules():
    assert rules.resolve_filters("altlex", plicit="implicit") == {"plicit": "all"}
    assert rules.resolve_filters("pdtb", num_sent="all", num_causal="all", plicit="all") == {
        "num_sent": "all", "num_causal": "all", "plicit": "all",
    }
    assert rules.resolve_filters("because", num_sent="intra") == {"num_sent": "all"}
    assert rules.resolve_filters("jpfinresults", num_sent="inter") == {"num_sent": "all"}
    assert rules.resolve_filters("esl", plicit="explicit") == {"plicit": "explicit"}
    assert rules.resolve_filters("esl", num_causal="single") == {"num_causal": "all"}
    for corpus, option in (
        ("because", {"num_sent": "inter"}),
        ("jpfinresults", {"num_sent": "intra"}),
        ("esl", {"num_causal": "multi"}),
    ):
        with pytest.raises(ValueError):
            rules.resolve_filters(corpus, **option)
    with pytest.raises(AssertionError):
        rules.resolve_filters("jpfinresults", plicit="implicit")
    rules.check_pair("altlex", SEQUENCE)
    with pytest.raises(ValueError):
        rules.check_pair("reco", SPAN)


def test_rule_tables(spark):
    assert rules.capability_table(spark).count() == 17
    assert rules.filter_rules(spark).count() == 99


def test_templates(spark, tmp_path):
    assert len(TEMPLATES) == 10
    for name, template in TEMPLATES.items():
        check_template(template)
        readers.write_template(spark, template, str(tmp_path / "good" / f"{name}.json"))
    rows = readers.read_templates(spark, str(tmp_path / "good")).collect()
    assert {r.name for r in rows} == set(TEMPLATES)
    for row in rows:
        assert row.missing_keys == []
        assert {k: row[k] for k in TEMPLATES[row.name]} == TEMPLATES[row.name]
    assert readers.load_template(spark, str(tmp_path / "good" / "span_detection.json")) == TEMPLATES["span_detection"]
    broken = {k: "x" for k in REQUIRED_KEYS if k != "question"}
    readers.write_template(spark, broken, str(tmp_path / "bad" / "t.json"))
    assert readers.read_templates(spark, str(tmp_path / "bad")).first().missing_keys == ["question"]
    with pytest.raises(ValueError):
        readers.load_template(spark, str(tmp_path / "bad" / "t.json"))


def test_filter_tag():
    assert sinks.filter_tag() == "all"
    assert sinks.filter_tag(num_sent="intra", plicit="explicit") == "intra_explicit"


def answer_right(prompts):
    """Reads the answer off the prompt's own last sentence."""
    text = prompts.str.rsplit("Text: ", n=1).str[1].str.strip()
    effect, cause = text.str.split(" because ").str[0], text.str.split(" because ").str[1]
    return "Causes: [" + cause + "]\nEffects: [" + effect + "]"


def test_evaluate_spans(spark, data_dir, tmp_path):
    out = str(tmp_path)
    scores = evaluate.evaluate_prompts(
        spark, SPAN, "fincausal", data_dir, out, TEMPLATES["span_detection"], answer_right, "stub", shot=3
    ).first()
    assert scores.exact_match == 1.0 and scores.f1 == 1.0
    files = os.path.join(out, "reports", "task=span_detection", "dataset=fincausal", "filters=all", "model=stub", "run=template_3_42")
    lines = [line for f in os.listdir(files) if f.endswith(".json") for line in open(os.path.join(files, f))]
    entries = json.loads(lines[0])
    assert len(lines) == 1 and list(entries) == sorted(entries)
    assert entries["task_type"] == SPAN and entries["intra-/inter-sent"] == "all" and entries["shot"] == 3
    assert spark.read.option("header", True).option("multiLine", True).csv(os.path.join(out, "predictions")).count() == 7


def test_evaluate_words(spark, data_dir, tmp_path):
    scorer = lambda prompts: prompts.str.replace("(?s).*", "[Labels]\n", regex=True)
    scores = evaluate.evaluate_prompts(
        spark, SPAN, "fincausal", data_dir, str(tmp_path), TEMPLATES["span_detection_by_word"], scorer, "stub",
        shot=1, by_word=True,
    ).first()
    assert scores.accuracy == 0.0 and scores.exact_match == 0.0
    assert scores.class_accuracy["accuracy_0"] == 0.0


def test_rows_by_word_hold_each_text_once(spark):
    words = [f"word{i}" for i in range(300)]
    examples = [(k, f"text {k} " * 300, f"tagged {k}", f"output {k}", words, ["O"] * 300, [str(k)] * 300) for k in (0, 0, 1)]
    names = "example_id long, text string, tagged_text string, output string, tokens array<string>, tags array<string>, pred array<string>"
    rows = evaluate.prediction_rows(spark.createDataFrame(examples, names), SPAN, by_word=True).collect()
    assert len(rows) == 900 and sum(len(r.text or "") for r in rows) == sum(len(e[1]) for e in examples)
    by_row = {}
    for r in rows:
        by_row.setdefault(r.row, []).append(r)
    got = []
    for own in by_row.values():
        own.sort(key=lambda r: r.pos)
        first = own[0]
        got.append((first.example_id, first.text, first.tagged_text, first.output, *([r[c] for r in own] for c in ("token", "tag", "pred_tag"))))
    assert sorted(got) == sorted(examples)


def test_evaluate_classes(spark, data_dir, tmp_path):
    scorer = lambda prompts: prompts.str.replace("(?s).*", "N1", regex=True)
    for task, corpus in ((SEQUENCE, "ctb"), (CHAIN, "reco")):
        scores = evaluate.evaluate_prompts(
            spark, task, corpus, data_dir, str(tmp_path), TEMPLATES[task], scorer, "stub", shot=1
        ).first()
        assert scores.recall == 1.0 and scores.accuracy == 0.5
    with pytest.raises(ValueError):
        evaluate.build_prompts(spark.range(1), SEQUENCE, TEMPLATES[SEQUENCE], 2)


def test_encoder_inputs(spark, data_dir):
    rows = corpora.load_corpus(spark, "ctb", SEQUENCE, data_dir)
    encode = lambda text: F.concat(F.array(F.lit(101)), F.transform(F.split(text, " "), F.length), F.array(F.lit(102)))
    got = evaluate.sequence_inputs(rows, encode, limit=4).first()
    assert len(got.input_ids) == len(got.attention_mask) == 4
    rows = corpora.load_corpus(spark, "fincausal", SPAN, data_dir)
    none = F.struct(F.lit(101).alias("id"), F.lit(None).cast("int").alias("word"))
    pieces = lambda tokens: F.concat(
        F.array(none), F.transform(tokens, lambda t, i: F.struct(F.length(t).alias("id"), i.alias("word"))), F.array(none)
    )
    got = evaluate.span_inputs(rows, pieces, limit=10).first()
    assert got.labels == [-100, 2, 2, 2, 0, 1, 1, -100] and len(got.input_ids) == 8
    rows = corpora.load_corpus(spark, "reco", CHAIN, data_dir)
    words = lambda text: F.transform(F.split(text, " "), F.length)
    got = evaluate.chain_inputs(rows, words, 512, start=101, separator=102).where("example_id = 'reco_train1_0'").first()
    assert got.input_ids == [101, 1, 1, 102, 1, 102, 1, 102, 1, 102, 1, 102]
    assert got.labels == 0


def test_encoder_reports(spark):
    rows = spark.createDataFrame([([0.1, 0.9], 1), ([0.6, 0.4], 1), ([0.5, 0.5], 0)], "scores array<double>, labels int")
    got = evaluate.encoder_report(rows, SEQUENCE).first()
    assert (got.accuracy, got.precision, got.recall) == pytest.approx((2 / 3, 1.0, 0.5))
    tokens = [([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [1, -100, 2]), ([[0.0, 1.0, 0.0]], [0])]
    rows = spark.createDataFrame(tokens, "scores array<array<double>>, labels array<int>")
    got = evaluate.encoder_report(rows, SPAN).first()
    assert (got.accuracy, got.exact_match, got.precision, got.recall) == pytest.approx((2 / 3, 0.5, 0.75, 1.0))
