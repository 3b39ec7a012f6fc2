"""Maps of fonts from codes to text, and lengths of streams."""

from pyspark.sql import functions as F

from parchment.functions import text
from parchment.operators import fonts


def read(spark, text):
    got = fonts.unicode_maps(spark.createDataFrame([(1, text)], "font int, cmap string"), ["font"], "cmap")
    return {r.cid: r.text for r in got.collect()}


def test_blocks(spark):
    assert read(spark, "2 beginbfchar <01> <0041> <0002> <00660069> endbfchar") == {1: "A", 2: "fi"}
    assert read(spark, "beginbfrange <10> <12> <0061> <20> <22> [<0041> <0042>] <30><30>[<0043><0044>] endbfrange") == {16: "a", 17: "b", 18: "c", 32: "A", 33: "B", 48: "C"}
    assert read(spark, "begincidrange <0061> <0062> 7 endcidrange begincidchar 9 <0063> endcidchar") == {7: "a", 8: "b", 9: "c"}
    assert read(spark, "beginbfrange <01> <02> <D83DDE00> endbfrange") == {1: "\U0001f600", 2: "\U0001f601"}


def test_odd_maps(spark):
    assert read(spark, "beginbfchar <01> <00 4\n1> <02> <D83D0042> <03> <004> <04> <004142> endbfchar") == {1: "A", 2: "B", 3: "@", 4: "A"}
    assert read(spark, "beginbfrange <01> <0002> <0041> <05> <03> <0041> endbfrange begincidchar <01> 5 <02> 6 endcidchar beginbfchar 1 <0041> endbfchar") == {}
    assert read(spark, "beginbfchar % <01> <0041>\n<02> <0042> endbfchar endcmap beginbfchar <03> <0043> endbfchar") == {2: "B"}
    assert read(spark, "") == {} and read(spark, None) == {}


def test_last_text_counts_but_blanks_stay(spark):
    entry = lambda *texts: "beginbfchar " + " ".join(f"<01> <{t}>" for t in texts) + " endbfchar"
    assert read(spark, entry("0041", "0042")) == {1: "B"} and read(spark, entry("0020", "00A0", "00A0")) == {1: " "}
    assert read(spark, entry("0041", "00A0")) == {1: "\u00a0"} and read(spark, entry("00A0", "0020")) == {1: " "} and read(spark, entry("0020", "0041", "00A0")) == {1: "\u00a0"}


def test_lengths_stay_in_place(spark):
    def patched(source):
        return spark.createDataFrame([(source,)], "s string").select(text.inline_lengths(F.col("s")).alias("s")).first().s

    assert patched("<< /Length 5 0 R >> x 5 0 obj 42 endobj") == "<< /Length 42    >> x 5 0 obj 42 endobj"
    assert patched("5 0 obj 1 endobj /Length\n5\x000 R /Length 5 1 R 5 0 obj\n2\nendobj") == "5 0 obj 1 endobj /Length 2     /Length 5 1 R 5 0 obj\n2\nendobj"
    for same in ("/Length 5 0 R 5 0 obj 1234567 endobj", "/Length 5 0 R 15 0 obj 1 endobj 1.5 0 obj 1 endobj", "/Length\u00a05 0 R 5 0 obj 1 endobj", "no", "", None, "/Length 3"):
        assert patched(same) == same
    long = "x" * 300_000 + "/Length 5 0 R" + "y" * 300_000 + " 5 0 obj 9 endobj"
    assert patched(long) == long.replace("5 0 R", "9    ")


def test_strings_names_and_numbers(spark):
    assert read(spark, r"beginbfchar (\001) (\000A) <02> (\000\() <03> (a(b\)c)d%e) endbfchar % (comment" + "\nbeginbfchar <04> <0044> endbfchar") == {1: "A", 2: "(", 3: "愨戩挩搥", 4: "D"}
    assert read(spark, "beginbfrange <01> <04> [<0041> /uni0042 67 /nothing] <09> <09> [/u1F600.alt] (\\007) (\\010) (\\000x) endbfrange") == {1: "A", 2: "B", 3: "C", 9: "\U0001f600", 7: "x", 8: "y"}
    got = fonts.unicode_maps(spark.createDataFrame([(1, "beginbfrange <01> <01> [/eacute] endbfrange")], "font int, cmap string"), ["font"], "cmap", {"eacute": "é"}).collect()
    assert [(r.cid, r.text) for r in got] == [(1, "é")]
    assert fonts.bytes_of_string("a\\n\\\r\nb\\051\\7x\\y((z))) rest", 0) == (b"a\nb)\x07xy((z))", len("a\\n\\\r\nb\\051\\7x\\y((z)))")) and fonts.bytes_of_string("open (", 0) == (b"open (", 6)
