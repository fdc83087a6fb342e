"""Rows worked out by hand: typed replacement, HTTP structure, encoding, validation, artifacts."""

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import httpstruct, hygiene, noise
from tokenloom.operators import induce, matcher, mining, validate
from tokenloom.plans.artifact import Artifact
from tokenloom.plans.build import build_vocabulary
from tokenloom.plans.config import Build, Contract, Trainer


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None),
        ("", ""),
        ("from 10.0.0.255 to 10.0.0.256", "from <IPV4> to 10.0.0.256"),
        ("2024-01-02T03:04:05Z", "<TS>"),
        ("id 1234567 and 12345", "id <NUM_POW10_6> and 12345"),
        ("at 1700000000 s", "at <TS> s"),
        ("h:8080", "h:<PORT>"),
        ("d41d8cd98f00b204e9800998ecf8427e", "<HASH>"),
        ("deadbeefdeadbeef", "<HEX>"),
    ],
)
def test_generic_rules(spark, text, want):
    assert one(spark, text, hygiene.generic) == want


def test_hex_beside_other_text_is_typed(spark):
    got = one(spark, "Cookie: s=" + "0a1b2c3d" * 4 + "; Path=/", hygiene.http)
    assert "<HASH>" in got and "0a1b2c3d" not in got


@pytest.mark.parametrize(("text", "want"), [("d41d8cd98f00b204e9800998ecf8427e", "<HASH>"), ("a sentence of words", None), ("", None), (None, None)])
def test_noise(spark, text, want):
    assert one(spark, text, noise.classify) == want


def test_noise_among_many_words_is_weighed_by_its_length(spark):
    blob, word = "0123456789abcdef" * 2, "word "
    texts = {f"{blob}\u00a0abcde": "<HASH>", f"{blob} abcdef": None, f"{blob}, {blob}": None, f"{blob}=== x": None, f"{word * 9}{blob * 9}Q== {blob}": "<B64>", f"\x85{blob}\t{blob[:16]}\n": "<HASH>"}
    df = spark.createDataFrame(list(texts.items()), "x string, want string")
    shown = noise.classify(F.col("x"))
    assert [r.kind for r in df.select(shown.alias("kind")).collect()] == list(texts.values())
    # each piece of a text was looked at before, whatever its shape
    assert "split(" not in str(shown)


def test_greedy_takes_the_longest(spark):
    vocab = {"[PAD]": 0, "[UNK]": 1, "GET": 5, "/": 6, "index": 7, "in": 8}
    assert one(spark, "GET/index", lambda x: matcher.encoded(x, vocab)) == [5, 6, 7]
    assert one(spark, "GET~in", lambda x: matcher.encoded(x, vocab)) == [5, 1, 8]


def test_many_hex_tokens_are_an_issue(spark):
    tokens = [f"{k:032x}" for k in range(50)] + ["the", "of", "<IPV4>"]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    codes = {r.code for r in validate.entropy_issues(df, Contract().typed_symbols()).collect()}
    assert {"entropy_hex_overflow", "typed_hygiene_leak_hex"} <= codes


def test_pieces_of_typed_symbols_are_an_issue(spark):
    df = spark.createDataFrame([("<IP",), ("IPV4>",), ("plain",)], "token string")
    assert [r.code for r in validate.broken_symbols(df, ["<IPV4>"]).collect()] == ["typed_symbol_substring"]


def test_tag_interiors_are_not_mined(spark):
    df = spark.createDataFrame([("<METHOD> GETGET <URL> pathpath",)], "text string")
    pieces = {r.piece for r in mining.counted(df, mining.segments(F.col("text"), mining.boundaries("default"))).collect()}
    assert pieces == {"GETGET", "pathpath"}


def test_vocabulary_reserves_tags_and_survives_a_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([(k, f"GET /item/{k}?q=1 HTTP/1.1\r\nHost: shop.org\r\n\r\na=1&b=two") for k in range(40)], "id bigint, text string")
    art = build_vocabulary(texts, Build(trainer=Trainer(vocab_size=512, min_freq=1, len_max=12, preset="http"), contract=Contract(structured_input_mode="http", typed_hygiene_mode="http")))
    assert len(art.vocab) <= 512 and set(httpstruct.TAGS) <= set(art.vocab)
    assert sorted(art.vocab.values()) == list(range(len(art.vocab)))
    art.save(tmp_path / "a")
    assert Artifact.load(tmp_path / "a").vocab == art.vocab


def test_a_vocabulary_needs_room_for_the_base(spark):
    cands = spark.createDataFrame([], "token string, freq bigint, score double")
    with pytest.raises(ValueError, match="no room"):
        induce.vocabulary(cands, ["a", "b", "c"], 2)


def test_structure_of_a_raw_request(spark):
    got = one(spark, "POST /a?x=%41 HTTP/1.1\nCookie: sid=1\n\n{\"b\": 1, \"a\": \"w\"}", httpstruct.structured)
    assert got.startswith("<METHOD> POST <URL> / a <QK> x <QVAL> <URLENC> <PROT> HTTP/1.1 <EOL>")
    assert got.index("<K:a>") < got.index("<K:b>")


def test_a_request_is_cut_and_read_once(spark):
    """What several parts of a request need is worked out once for a text: its sections are read at one place of the plan, not at one for each part."""
    plan = spark.createDataFrame([("",)], "x string").select(httpstruct.structured(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 1


def test_headers_by_their_first_colon(spark):
    got = one(spark, "GET / HTTP/1.1\n : a\n:b\n\u2003X-Y :\u00a0c:d\u3000\nnone", httpstruct.structured)
    assert got == "<METHOD> GET <URL> / <PROT> HTTP/1.1 <EOL> <HDR> <EMPTY> <SEP> a <EOL> <HDR> x-y <SEP> c:d <EOL>"


def test_characters_of_odd_texts(spark):
    """Nulls and empty texts have none, one beyond 16 bits is one; no text is laid out as an array of its characters."""
    df = spark.createDataFrame([(None,), ("",), ("aba\n\t",), ("\U0001f600é\x00",)], "text string").repartition(2)
    found = mining.characters(df, also="~a")
    assert [r.ch for r in found.collect()] == sorted({*"ab\n\té\x00~", "\U0001f600"})
    assert "regexp_extract_all" not in found._jdf.queryExecution().analyzed().toString()


def test_authorities_and_triplets_in_one_pass(spark):
    """A port follows a whole name, from its beginning; a lone percent sign parts nothing."""
    rules = lambda c: hygiene.percent_normalized(hygiene.replaced(c, (hygiene.AUTHORITY_PORT, "$1<PORT>")))
    assert one(spark, "a.b:80/ 1:2:80 x:1234567/ :80/ %%2fz %zz%", rules) == "a.b:<PORT>/ 1:2:<PORT> x:1234567/ :80/ %%2F z %zz%"
    assert "++:" in hygiene.AUTHORITY_PORT  # a name without a port is tried once, not once for each of its letters
