import pytest
from pyspark.sql import functions as F

from verbaloom.functions import codes, content, literals, segment

TEXTS = [None, "", " \t\n", "\u00a0", "\u001c", "12 34", "🙂 🙂", "https://a.b/c", "HTTPS://A.B", "www.site.org", "me@site.org", "(see https://a.b/c).", "+1 555 0100", "$5 #7", "a", "abc", "word https://a.b", "Mr.Smith", "site.org", "日本", "नमस्ते"]


def letters(text):
    import re

    word = r"[^\W]"
    literal = re.compile(rf"""[(<\["'«]*(?:[A-Za-z][A-Za-z0-9+.-]*://\S+|[Ww]{{3}}\.\S+|(?:{word}|[.+-])+@(?:{word}|-)+(?:\.(?:{word}|-)+)+|(?:{word}|-)+(?:\.(?:{word}|-)+)*\.[a-z]{{2,24}}(?:[/?#:]\S*)?)[)>\]"'».,;:!?]*""")
    return sum(0 if literal.fullmatch(t) else sum(map(str.isalpha, t)) for t in (text or "").split())


def test_letters_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    rows = df.select("text", content.letter_count(F.col("text")).alias("n"), content.rule_label(F.col("text")).alias("r"), content.is_blank(F.col("text")).alias("b")).collect()
    for r in rows:
        assert r.n == letters(r.text), r
        assert r.b == (not (r.text or "").strip()), r
        assert r.r == ("und" if r.b else "zxx" if r.n == 0 else None), r


def test_codes(spark):
    cases = {"__label__en": "eng", "eng_Latn": "eng", "zh-Latn": "zho", "EN": "eng", "als": "gsw", "iw": "heb", "xx": "xx", "__label__deu_Latn": "deu"}
    df = spark.createDataFrame([(k,) for k in cases], "label string")
    assert {r.label: r.c for r in df.select("label", codes.to_iso639_3(F.col("label")).alias("c")).collect()} == cases
    names = {"Spanish": "es", "norwegian nynorsk": "nn", "pt-BR": "pt", "zho_Hans": "zh", "cmn": "zh", "arb": "ar", "nob": "no", "yue": "yue", "iw": "he", "als": "sq", "und": None, "zxx": None, "mul": None}
    df = spark.createDataFrame([(k,) for k in names], "v string")
    assert {r.v: r.c for r in df.select("v", codes.to_language(F.col("v")).alias("c")).collect()} == names
    sizes = spark.createDataFrame([(0,), (1 << 20,), (50 << 20,), (3 << 30,)], "n long").select(codes.human_size(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["0 MB", "1.0 MB", "50 MB", "3.0 GB"]


LITERAL_CASES = [
    ("see https://site.org/a(b). ok", [("url", "https://site.org/a(b)")]),
    ("run `x = 1` now", [("code", "`x = 1`")]),
    ("[t](http://a.b/(c)) z", [("link_target", "](http://a.b/(c))")]),
    ("<b>bold</b> &amp; %s {name} ${x} {{y}}", [("tag", "<b>"), ("tag", "</b>"), ("tag", "&amp;"), ("placeholder", "%s"), ("placeholder", "{name}"), ("placeholder", "${x}"), ("placeholder", "{{y}}")]),
    ("mail me@site.org or @me #tag", [("email", "me@site.org"), ("mention", "@me"), ("hashtag", "#tag")]),
    ("in /usr/lib and ~/x or C:\\dir\\f.txt", [("path", "/usr/lib"), ("path", "~/x"), ("path", "C:\\dir\\f.txt")]),
    ("call parseFileName or snake_case", [("identifier", "parseFileName"), ("identifier", "snake_case")]),
    ("at 12:30, 1,000 or v2", [("number", "12:30"), ("number", "1,000")]),
    ("id 123e4567-e89b-12d3-a456-426614174000", [("encoded", "123e4567-e89b-12d3-a456-426614174000")]),
    ("```\na b\n```\nend", [("code_block", "```\na b\n```")]),
    ("🙂 see site.org", [("url", "site.org")]),
    ("Mr.Smith left", []),
]


def test_literals(spark):
    df = spark.createDataFrame([(t,) for t, _ in LITERAL_CASES], "text string").withColumn("s", literals.find_literals(F.col("text")))
    rows = {r.text: r.s for r in df.collect()}
    for text, wanted in LITERAL_CASES:
        assert [(s.kind, s.text) for s in rows[text]] == wanted, text
        assert all(text[s.start : s.end] == s.text for s in rows[text])


def test_mask_and_restore(spark):
    df = spark.createDataFrame([(t,) for t, _ in LITERAL_CASES] + [("zxq and qzx 12",)], "text string")
    df = df.withColumn("s", literals.find_literals(F.col("text"))).withColumn("m", literals.mask(F.col("text"), F.col("s")))
    rows = df.select("text", "m", literals.restore(F.col("m"), F.col("m.text")).alias("back"), literals.restore(F.col("m"), F.lit("lost")).alias("lost"), F.array_join(F.transform(literals.pieces(F.col("text"), F.col("s")), lambda p: p.piece), "").alias("joined")).collect()
    for r in rows:
        assert r.joined == r.text
        assert r.back == (r.text if r.m else None) and r.lost is None
    assert next(r.m for r in rows if r.text.startswith("zxq")) is None


def test_kinds_and_keep_terms(spark):
    with pytest.raises(ValueError):
        literals.chosen_kinds(["nope"])
    with pytest.raises(TypeError):
        literals.keep_patterns("one")
    with pytest.raises(ValueError):
        literals.keep_patterns([" "])
    df = spark.createDataFrame([("Nike's Nikes C++ 5",)], "t string")
    found = df.select(literals.find_literals(F.col("t"), keep=["Nike", "C++"], preserve=["number"]).alias("s")).first().s
    assert [(s.kind, s.text) for s in found] == [(None, "Nike"), (None, "C++"), ("number", "5")]
    assert df.select(literals.find_literals(F.col("t"), keep=["Nike"], preserve=False).alias("s")).first().s == []


SENTENCES = {
    "One. Two! three? Four": ["One.", "Two! three?", "Four"],
    "Dr. Smith and J. Doe came. They left.": ["Dr. Smith and J. Doe came.", "They left."],
    "a\nb\n\n c": ["a", "b", "c"],
    "你好。再见。": ["你好。", "再见。"],
    'He said "go." Then left.': ['He said "go."', "Then left."],
    "": [],
    "  x  ": ["x"],
    " \n ": [],
}


def test_sentences(spark):
    df = spark.createDataFrame([(t,) for t in SENTENCES], "text string").withColumn("s", segment.split_sentences(F.col("text")))
    for r in df.select("text", "s").collect():
        assert r.s.sentences == SENTENCES[r.text]
        assert len(r.s.separators) == len(r.s.sentences) + 1
        assert "".join(a + b for a, b in zip(r.s.separators, [*r.s.sentences, ""], strict=True)) == r.text


def test_fit():
    text = "one two, three four five six seven"
    offsets = [(i, i + len(w)) for w in text.split() for i in [text.index(w)]]
    for window in range(1, 9):
        out = segment.fit(text, offsets, window)
        assert "".join(a + b for a, b in out) == text
        assert all(len(a.split()) <= window for a, _ in out)
    with pytest.raises(ValueError):
        segment.fit(text, offsets, 0)
