import datetime
import uuid

from pyspark.sql import functions as F

from skein.functions import dates, ids, text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'date'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="Hello world. How are you? I am fine!") == ["Hello world.", "How are you?", "I am fine!"]
    assert one(spark, T.sentences(F.col("t")), t="value is 3.14 exactly") == ["value is 3.14 exactly"]
    assert one(spark, T.sentences(F.col("t")), t="पहला॥दूसरा") == ["पहला॥", "दूसरा"]


def test_loops(spark):
    assert one(spark, T.collapse_loops(F.col("t")), t="a a a a a b") == "a a a a a b"
    assert one(spark, T.collapse_loops(F.col("t")), t="a a a a a a b\nओ, ओ, ओ, ओ, ओ, ओ, ओ,") == "a a a b\nओ, ओ, ओ,"
    for raw, want in (("ओ, " * 8, "ओ, ओ, ओ,"), ("ओ, ओ, ओ ओ, ओ, ओ, ओ ओ", "ओ, ओ, ओ"), ("ॐ\tॐ  ॐ", "ॐ ॐ ॐ"), ("राम " * 5, "राम राम राम राम राम"), ("- - - - - - -", "- - - - - - -"), ("", ""), ("x\n\ny y", "x\n\ny y")):
        assert one(spark, T.collapse_loops(F.col("t")), t=raw) == want
    assert one(spark, T.loop_count(F.col("t")), t="राम " * 6 + "\nb " + "ओ, " * 8) == 2
    assert one(spark, T.collapse_loops(F.col("t")), t="ब्लूम लाइक " * 8).split() == ["ब्लूम", "लाइक"] * 8


def test_inventions_are_cut(spark):
    out = one(spark, T.excise(F.col("t"), ["lorem", "a.b"], ["ipsum"]), t="alorem ipsumb, axb  a.b ipsum, ipsum ,, कर दो")
    assert (out.text, out.n) == ("a b, axb कर दो", 2)
    assert one(spark, T.excise(F.col("t"), ["सब्सक्राइब"], ["करते", "हैं"]), t="अब तुम कर दो").text == "अब तुम कर दो"


def test_all_normalisations(spark):
    from skein.operators.cleaning import normalised

    out = one(spark, normalised(F.col("t"), {"gyan": "ज्ञान"}, {"ध्यन": "ध्यान"}, ["सब्सक्राइब"], ["करते"]), t="gyan, ध्यन (Third Eye) है\nसब्सक्राइब करते " + "ओ, " * 7)
    assert out.text == "ज्ञान, ध्यान है\nओ, ओ, ओ,"
    assert out.glosses == ["Third Eye"] and out.counts.asDict() == {"loanwords": 1, "natives": 1, "spellings": 0, "glosses": 1, "inventions": 1, "loops": 1}


def test_token_map_keeps_punctuation(spark):
    assert one(spark, T.map_tokens(F.col("t"), {"yoga": "Yoga"}), t="(yoga),  yogas yoga!") == "(Yoga), yogas Yoga!"


def test_glosses(spark):
    out = one(spark, T.strip_glosses(F.col("t")), t="स्वामी (Master) और नेत्र (Third Eye) (आँख)")
    assert out.glosses == ["Master", "Third Eye"] and "(आँख)" in out.text and "Master" not in out.text


def test_names_and_places(spark):
    assert one(spark, T.names(F.col("t")), t="Suman Ji, SUMAN, Neelam Richa Ji") == ["Suman", "Neelam Richa"]
    for raw, want in (("PITAMPURA DELHI", "DELHI"), ("Chhattarpur, Delhi", "DELHI"), ("Panchkula", "PANCHKULA")):
        assert one(spark, T.place(F.col("t")), t=raw) == want


def test_dedupe_keeps_first_spelling(spark):
    assert one(spark, T.dedupe(F.col("a")), a=["Rain", " rain", "", "SUN", "sun ", None, "Rain drop"]) == ["Rain", "SUN", "Rain drop"]


def test_topic_terms(spark):
    stop = ["best", "sittings"]
    assert one(spark, T.topic_terms(F.col("t"), stop, 2), t="rain rain barish monsoon rain") == ["rain", "barish"]
    assert one(spark, T.topic_terms(F.col("t"), stop), t="best sittings") == []


def test_durations_and_clocks(spark):
    for x, want in ((23.42, 1422), (30.3, 1830), (5.61, None), (-1.0, None)):
        assert one(spark, dates.duration_seconds(F.col("x")), x=x) == want
    for raw, want in (("6.30 AM", "06:30"), ("630 AM", "06:30"), ("8 PM", "20:00"), ("12 AM", "00:00"), ("NOON", "12:00"), ("soon", None)):
        assert one(spark, dates.clock_24(F.col("t")), t=raw) == want


def test_seasons(spark):
    assert [one(spark, dates.season(F.col("d")), d=datetime.date(2020, m, 1)) for m in (1, 4, 8, 11)] == ["winter", "summer", "monsoon", "post-monsoon"]


def test_uuid5_is_the_standard_one(spark):
    for name in ("a|0|x", "देव/é"):
        assert one(spark, ids.uuid5(uuid.NAMESPACE_URL, F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_dated_key(spark):
    assert one(spark, ids.dated_key(F.col("d"), F.lit(2), F.lit(4)), d=datetime.date(2005, 4, 13)) == "2005-04-13|2|4"


def test_thoughts_and_json(spark):
    assert one(spark, T.without_thoughts(F.col("t")), t="a <think>x</think> b <think>open") == "a  b"
    assert one(spark, T.json_object(F.col("t")), t='sure {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'


def test_clock_text(spark):
    assert one(spark, T.clock(F.col("x")), x=3725.9) == "01:02:05"


def test_texts_without_loops_or_rules_cost_no_look_at_their_tokens(spark):
    """What the quick ways give is what the token by token ones give, and one look serves a text's loops and their number."""
    from skein.functions import text as T

    texts = ["a a a a a a b", "a, a. (a) a a a! a", "the (the) the! other de the;", "no no no no no", "x y z " * 9, "", " \n the\tTHE \n", "theother the-other thé", "- - - - - - -", "b b b b b b b\nc c\nd d d d d d", "..the.. the", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(t, T.collapsed(t).alias("c"), T.collapse_loops(t).alias("short"), T.loop_count(t).alias("n"), T.map_tokens(t, {"the": "THE"}).alias("m"), T.mapped_count(t, {"the": "THE"}).alias("k")).collect()
    marks = T.EDGE_MARKS
    for r in got:
        if r.t is None:
            assert r.short is None and r.m is None
            continue
        lines, n, mapped, count = [], 0, [], 0
        for line in r.t.split("\n"):
            out, run = [], []
            for w in [*line.split(), None]:
                if run and (w is None or w.strip(marks) != run[0].strip(marks) or not w.strip(marks)):
                    n += len(run) >= 6
                    out += run[:3] if len(run) >= 6 else run
                    run = []
                run.append(w)
            lines.append(" ".join(out))
            count += sum(w.strip(marks) == "the" for w in line.split())
            mapped.append(" ".join(w.replace("the", "THE") if w.strip(marks) == "the" else w for w in line.split()))
        assert (r.short, r.n, r.c.text, r.c.n) == ("\n".join(lines), n, "\n".join(lines), n)
        assert (r.m, r.k) == ("\n".join(mapped), count)


def test_few_and_many_rules_map_alike(spark):
    from skein.functions import text as T

    df = spark.createDataFrame([("a a, (a) b ab a-b ..c.. $ a.b\n a\tb c",)], "t string")
    for rules in ({"a": "$1\\", "c": "see d"}, {"a": "b", "b": "c"}, {",a": "x", "c": "C"}):
        many = {**rules, **{f"no{i}": "N" for i in range(9)}}
        few_text, many_text = df.select(T.map_tokens(F.col("t"), rules), T.map_tokens(F.col("t"), many)).first()
        assert few_text == many_text
    text = "a a, (a) b ab a-b ..c.. $ a.b\n a\tb c"
    assert df.select(T.mapped_count(F.col("t"), {"a": "x", "c": "y"})).first()[0] == sum(w.strip(T.EDGE_MARKS) in ("a", "c") for w in text.split())
