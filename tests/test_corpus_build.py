import gzip

import pytest

from corpusforge.sources import corpus as cp


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)


def test_build_pair_corpus(spark, tmp_path):
    al = tmp_path / "aligned"
    write(al / "eng-jav" / "dev.id", "eng\tjav\neng\txxx\neng\teng\neng\tjav\n")
    write(al / "eng-jav" / "dev.src", "a\nb\nc\n\n")
    write(al / "eng-jav" / "dev.trg", "A\nB\nC\nD\n")
    write(al / "msa-msa" / "train.id.gz", "s1\tzlm_Latn\tzsm_Latn\ns2\tban\tind\n")  # train files name their source first
    write(al / "msa-msa" / "train.src.gz", "e\n f ")
    write(al / "msa-msa" / "train.trg.gz", "E\nF\n")
    write(al / "eng-sun" / "test.id", "eng\tsun\neng\tsun\n")
    write(al / "eng-sun" / "test.src", "x\n")
    write(al / "eng-sun" / "test.trg", "X\nY\n")
    write(tmp_path / "wide" / "dev.csv", ',one,two\n0,g,G\n1,,"H, h"\n')
    write(tmp_path / "lexicon" / "two.csv", "indonesian,two\nkata,word\n")
    out = str(tmp_path / "out")
    args = (str(al), str(tmp_path / "wide"), str(tmp_path / "lexicon"))
    table, status = cp.build_pair_corpus(spark, out, *args)
    assert sorted(map(tuple, table.collect()), key=str) == sorted([
        ("english", "javanese", "a", "A", "dev", "tatoeba-eng-jav"),  # unknown code, one code twice and an empty text go
        ("malaysian malay", "malaysian malay", "e", "E", "train", "tatoeba-msa-msa"), ("balinese", "indonesian", " f ", "F", "train", "tatoeba-msa-msa"),
        ("one", "two", "g", "G", "dev", "nusax-mt"), ("two", "one", "G", "g", "dev", "nusax-mt"),
        ("one", "two", None, "H, h", "dev", "nusax-mt"), ("two", "one", "H, h", None, "dev", "nusax-mt"),
        ("indonesian", "two", "kata", "word", "train", "nusax-lexicon"),
    ], key=str)
    told = {(r.data_source, r.data_split): (r.status, r.reason, r.n_rows) for r in status.collect()}
    assert told["tatoeba-eng-jav", "dev"] == ("loaded", None, 2) and told["tatoeba-msa-msa", "train"] == ("loaded", None, 2)
    assert told["tatoeba-eng-sun", "test"] == ("rejected", "line counts differ", None)
    assert told["tatoeba-ban-msa", "dev"] == ("rejected", "missing files", None)
    with pytest.raises(Exception, match="(?i)exist"):
        cp.build_pair_corpus(spark, out, *args)
