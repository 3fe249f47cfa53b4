"""S02-S14 on hand-made files (FIXTURES section 4)."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from corpusforge.sources import files as fl


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if path.endswith(".gz"):
        with gzip.open(path, "wt", newline="") as f:
            f.write(text)
    else:
        with open(path, mode, newline="") as f:
            f.write(text)


def aligned_tree(root):
    # good trio: inner blank line in .src, \r\n line ends, an empty source text, same-code pair, unmapped code
    write(f"{root}/eng-jav/dev.id", "eng\tjav\r\neng\tjav\r\njav\tjav\r\nxxx\tjav\r\n")
    write(f"{root}/eng-jav/dev.src", "one\r\n\r\nthree\r\nfour\r\n")
    write(f"{root}/eng-jav/dev.trg", "satu\r\ndua\r\ntelu\r\npapat\r\n")
    # train: three id columns, the first is thrown away
    write(f"{root}/eng-jav/train.id", "src-a\teng\tjav\nsrc-b\tjav\teng\n")
    write(f"{root}/eng-jav/train.src", "hello\nworld\n")
    write(f"{root}/eng-jav/train.trg", "halo\njagad\n")
    # .trg a line short -> the whole entry is rejected
    write(f"{root}/eng-sun/dev.id", "eng\tsun\neng\tsun\n")
    write(f"{root}/eng-sun/dev.src", "a\nb\n")
    write(f"{root}/eng-sun/dev.trg", "a\n")
    # a blank line in .id is skipped (pandas), so counts differ -> rejected
    write(f"{root}/ban-msa/test.id", "ban\tmsa\n\nban\tmsa\n")
    write(f"{root}/ban-msa/test.src", "x\ny\nz\n")
    write(f"{root}/ban-msa/test.trg", "x\ny\nz\n")


def test_aligned_zip_and_status(spark, tmp_path):
    root = str(tmp_path / "release")
    aligned_tree(root)
    pairs, status = fl.read_aligned(spark, root)
    rows = sorted((r.data_split, r.line_no, r.source_lang, r.target_lang, r.source_text, r.target_text)
                  for r in pairs.collect())
    assert rows == [
        ("dev", 0, "eng", "jav", "one", "satu"),
        ("dev", 1, "eng", "jav", "", "dua"),
        ("dev", 2, "jav", "jav", "three", "telu"),
        ("dev", 3, "xxx", "jav", "four", "papat"),
        ("train", 0, "eng", "jav", "hello", "halo"),
        ("train", 1, "jav", "eng", "world", "jagad"),
    ]
    st = {(r.subset, r.split): (r.status, r.reason) for r in status.collect()}
    assert st[("eng-jav", "dev")] == ("loaded", None)
    assert st[("eng-sun", "dev")] == ("rejected", "line counts differ")
    assert st[("ban-msa", "test")] == ("rejected", "line counts differ")
    assert st[("msa-msa", "train")] == ("rejected", "missing files")
    counts = {(r.data_source, r.data_split): r.n_rows for r in fl.manifest_counts(pairs, status).collect()}
    # empty text and same-code rows are filtered before counting
    assert counts[("tatoeba-eng-jav", "dev")] == 2
    assert counts[("tatoeba-eng-jav", "train")] == 2
    assert counts[("tatoeba-eng-sun", "dev")] is None


def test_gzip_lines(spark, tmp_path):
    p = str(tmp_path / "gz" / "train.src.gz")
    write(p, "a\n\nb\n")
    rows = sorted((r.line_no, r.text) for r in fl.read_gzip_lines(spark, p, 2).collect())
    assert [t for _, t in rows].count("") == 1 and [n for n, _ in rows] == list(range(len(rows)))


def test_line_file_drops_one_trailing_empty_line(spark, tmp_path):
    p = str(tmp_path / "f.src")
    write(p, "a\n\nb\n\n")
    assert sorted((r.line_no, r.text) for r in fl.read_line_file(spark, p).collect()) == [(0, "a"), (1, ""), (2, "b"), (3, "")]


def test_text_linebreaks(spark, tmp_path):
    p1, p2 = str(tmp_path / "t" / "a.txt"), str(tmp_path / "t" / "b.txt")
    write(p1, "x\ny\n")
    write(p2, "u\nv")  # no final newline
    got = sorted(r.text for r in fl.read_text_lines(spark, str(tmp_path / "t"), True).collect())
    assert got == ["u\n", "v", "x\n", "y\n"]
    assert sorted(r.text for r in fl.read_text_lines(spark, str(tmp_path / "t"), False).collect()) == ["u", "v", "x", "y"]


def test_wide_csv_dir(spark, tmp_path):
    d = tmp_path / "mt"
    write(str(d / "train.v2.csv"), ',ind,jav\n0,"a, b","say ""hi"""\n1,,"two\nlines"\n')
    write(str(d / "valid.csv"), ",ind,jav\n0,x,NA\n")
    df = fl.read_wide_csv_dir(spark, str(d))
    rows = sorted([(r.data_split, r.ind, r.jav) for r in df.collect()], key=lambda x: tuple(v or "" for v in x))
    assert rows == [("train", None, "two\nlines"), ("train", "a, b", 'say "hi"'), ("valid", "x", None)]
    assert "data_source" in df.columns and len(df.columns) == 4


def test_lexicon_dir(spark, tmp_path):
    d = tmp_path / "lexicon"
    write(str(d / "jav.csv"), "indonesian,jav\nmakan,mangan\nnan,turu\nkosong,\n")
    write(str(d / "sun.csv"), "indonesian,sun\nmakan,dahar\n")
    write(str(d / "README.md"), "not a lexicon\n")
    df = fl.read_lexicon_dir(spark, str(d))
    rows = sorted([(r.target_lang, r.source_text, r.target_text, r.data_split) for r in df.collect()],
                  key=lambda x: tuple("" if v is None else v for v in x))
    assert rows == [("jav", None, "turu", "train"), ("jav", "kosong", None, "train"),
                    ("jav", "makan", "mangan", "train"), ("sun", "makan", "dahar", "train")]


def test_nested_dir_with_missing_file(spark, tmp_path):
    d = tmp_path / "sentiment"
    for lang in ("jav", "sun"):
        for split in ("train", "test", "valid"):
            if (lang, split) == ("sun", "valid"):
                continue  # one file missing
            write(str(d / lang / f"{split}.csv"), f"text,label\n{lang}-{split},positive\n")
    df = fl.read_nested_dir(spark, str(d))
    got = sorted((r.language, r.split, r.text) for r in df.collect())
    assert len(got) == 5 and ("jav", "valid", "jav-valid") in got


def test_by_extension(spark, tmp_path):
    j = str(tmp_path / "train.json")
    write(j, '{"source_lang":"a","target_lang":"b","source_text":"x","target_text":"y"}\n')
    assert fl.read_by_extension(spark, j).count() == 1
    with pytest.raises(ValueError, match="csv, json or txt"):
        fl.read_by_extension(spark, str(tmp_path / "train.xml"))
    t = str(tmp_path / "train.txt")
    write(t, "just text\n")
    with pytest.raises(ValueError, match="missing columns"):
        fl.read_by_extension(spark, t)
    # the train suffix decides the reader of the validation file too
    c = str(tmp_path / "valid.csv")
    write(c, '{"source_lang":"c","target_lang":"d","source_text":"u","target_text":"v"}\n')
    both = fl.read_by_extension(spark, j, c)
    assert sorted(r.data_split for r in both.collect()) == ["train", "validation"]


def test_headerless_tsv(spark, tmp_path):
    tr, dv = str(tmp_path / "train.id"), str(tmp_path / "dev.id")
    write(tr, "src\teng\tjav\n")
    write(dv, "eng\tsun\n")
    assert fl.read_id_file(spark, tr, "train").first().asDict() == {"source_lang": "eng", "target_lang": "jav"}
    assert fl.read_id_file(spark, dv, "dev").first().asDict() == {"source_lang": "eng", "target_lang": "sun"}


def test_guard_and_reuse(spark, tmp_path):
    p = str(tmp_path / "out")
    df = spark.range(5)
    assert fl.guarded_write(df, p).count() == 5
    with pytest.raises(FileExistsError):
        fl.guarded_write(spark.range(3), p)
    assert fl.guarded_write(spark.range(3), p, reuse=True).count() == 5
    assert fl.guarded_write(spark.range(3), p, overwrite=True).count() == 3


def test_csv_index_is_unique(spark, tmp_path):
    p = str(tmp_path / "csv")
    a = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "k long, text string")
    b = spark.createDataFrame([(i + 10, f"u{i}") for i in range(3)], "k long, text string")
    fl.write_csv_with_index(a.unionByName(b), p, ["k"])
    back = spark.read.option("header", True).csv(p)
    assert sorted(int(r[0]) for r in back.collect()) == list(range(6))


def test_metrics_append(spark, tmp_path):
    p = str(tmp_path / "metrics")
    rows = spark.createDataFrame([("r", "train", "loss", 1)], "run string, phase string, metric string, value int")
    fl.append_metrics(spark, rows, p)
    out = fl.append_metrics(spark, rows, p)
    assert out.count() == 2 and dict(out.dtypes)["value"] == "double"


def test_csv_files_are_read_by_their_own_header(spark, tmp_path):
    d = tmp_path / "wide"
    d.mkdir()
    (d / "train.csv").write_text(",ind,jav\n0,satu,siji\n")
    (d / "test.csv").write_text(",jav,ind\n0,loro,dua\n")
    got = {r.data_split: (r.ind, r.jav) for r in fl.read_wide_csv_dir(spark, str(d)).collect()}
    assert got == {"train": ("satu", "siji"), "test": ("dua", "loro")}
    n = tmp_path / "nested" / "ban"
    n.mkdir(parents=True)
    (n / "train.csv").write_text("text,label\na,x\n")
    (n / "test.csv").write_text("label,text\ny,b\n")
    got = {r.split: (r.language, r.text, r.label) for r in fl.read_nested_dir(spark, str(tmp_path / "nested")).collect()}
    assert got == {"train": ("ban", "a", "x"), "test": ("ban", "b", "y")}


@pytest.fixture
def small_splits(spark):
    """File splits of about 200 bytes."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in keep:
        spark.conf.set(k, "200")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["a.txt", "a.txt.gz"])
@pytest.mark.parametrize("text", ["x\ny", "x\ny\n", "one e", "one ", "e", "e\n", " \n", "x\n\n", "a b\nc e\n\nlast", ""])
def test_final_line_end_is_kept_as_it_was(spark, tmp_path, name, text):
    write(str(tmp_path / "d" / name), text)
    rows = [r.text for r in fl.read_text_lines(spark, str(tmp_path / "d")).collect()]
    assert "".join(rows) == text


def test_final_line_ends_of_many_files(spark, tmp_path, small_splits):
    texts = {f"f{i}.txt" + (".gz" if i % 2 else ""): "word line\n" * (i * 7) + ("tail" if i % 3 else "") for i in range(1, 9)}
    for name, text in texts.items():
        write(str(tmp_path / "d" / name), text)
    rows = [r.text for r in fl.read_text_lines(spark, str(tmp_path / "d")).collect()]
    assert sorted(rows) == sorted(x for t in texts.values() for x in t.splitlines(keepends=True))


def test_line_numbers_across_splits_and_files(spark, tmp_path, small_splits):
    for f, n in (("b.txt", 90), ("a.txt", 40)):
        write(str(tmp_path / "d" / f), "".join(f"{f} line {i}\n" for i in range(n)))
    own = [(r.file.rsplit("/", 1)[1], r.line_no, r.text) for r in fl.read_line_file(spark, str(tmp_path / "d")).collect()]
    assert sorted(own) == sorted((f, i, f"{f} line {i}") for f, n in (("b.txt", 90), ("a.txt", 40)) for i in range(n))
    through = sorted((r.line_no, r.text) for r in fl.read_line_file(spark, str(tmp_path / "d"), across=True).collect())
    assert through == list(enumerate([f"a.txt line {i}" for i in range(40)] + [f"b.txt line {i}" for i in range(90)]))


def test_csv_records_over_split_ends(spark, tmp_path, small_splits):
    """Quoted fields with line ends, quotes and commas, longer than a split; every file by its own header."""
    import csv as pycsv

    rows = [(f"t{i}", ("line, one\n" * (i % 30)) + '"q"' * (i % 3), "" if i % 5 == 0 else f"y{i}") for i in range(60)]
    for name, head in (("p1.csv", ["a", "b", "Unnamed: 0"]), ("p2.csv", ["b", "a", "Unnamed: 0"])):
        os.makedirs(tmp_path / "d.csv", exist_ok=True)
        with open(tmp_path / "d.csv" / name, "w", newline="") as f:
            w = pycsv.writer(f, lineterminator="\r\n" if name == "p1.csv" else "\n")
            w.writerow(head)
            w.writerows(rows)
    df = fl.read_by_extension(spark, str(tmp_path / "d.csv"), required=["a", "b"])
    got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.a or "", r.b or "", r["Unnamed: 0"] or "") for r in df.collect())
    crlf = lambda s: s
    want = [("p1.csv", i, a, crlf(b), c) for i, (a, b, c) in enumerate(rows)] + [("p2.csv", i, b, a, c) for i, (a, b, c) in enumerate(rows)]
    assert got == sorted(want)


def test_files_of_each_suffix_and_validation_alone(spark, tmp_path):
    write(str(tmp_path / "t.json"), '{"text": "b"}\n\n{"text": "a"}\n')
    write(str(tmp_path / "v.txt"), "one\ntwo\n")
    j = fl.read_by_extension(spark, str(tmp_path / "t.json"), required=["text"]).collect()
    assert sorted((r.line_no, r.text, r.data_split) for r in j) == [(0, "b", "train"), (2, "a", "train")]
    v = fl.read_by_extension(spark, validation_file=str(tmp_path / "v.txt"), required=["text"]).collect()
    assert sorted((r.line_no, r.text, r.data_split) for r in v) == [(0, "one", "validation"), (1, "two", "validation")]
    with pytest.raises(ValueError, match="needed"):
        fl.read_by_extension(spark)


def test_gzip_trio_is_aligned(spark, tmp_path):
    root = str(tmp_path / "release")
    write(f"{root}/eng-jav/train.id.gz", "s\teng\tjav\n\ns\tjav\teng\n")
    write(f"{root}/eng-jav/train.src.gz", "hello\nworld\n")
    write(f"{root}/eng-jav/train.trg.gz", "halo\njagad\n")
    pairs, status = fl.read_aligned(spark, root)
    assert sorted((r.line_no, r.source_lang, r.source_text, r.target_text) for r in pairs.collect()) == [
        (0, "eng", "hello", "halo"), (1, "jav", "world", "jagad")]
    loaded = [r for r in fl.manifest_counts(pairs, status).collect() if r.status == "loaded"]
    assert [(r.data_source, r.data_split, r.n_rows) for r in loaded] == [("tatoeba-eng-jav", "train", 2)]


def test_csv_records_are_made_without_a_shuffle_of_lines(spark, tmp_path):
    """Lines stay where they are read: only records cut by a block's end are brought together."""
    rows = ["id,text"] + [f'{i},"line {i}\n""quoted"" {i}\n\nend"' for i in range(400)]
    (tmp_path / "a.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "b.csv").write_text("id,text\n1,open\n2,\"never closed\nlast")
    whole = fl._csv_records(spark, str(tmp_path))
    assert "Exchange hashpartitioning" not in whole._jdf.queryExecution().toString()
    want = sorted((r.file, r.rec, r.value) for r in whole.collect())
    assert [x[2] for x in want[:2]] == ["id,text", '0,"line 0\n""quoted"" 0\n\nend"'] and len(want) == 404
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("37b", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert sorted((r.file, r.rec, r.value) for r in fl._csv_records(spark, str(tmp_path)).collect()) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


