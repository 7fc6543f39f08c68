"""Property tests: the JVM text functions against plain Python on random
strings drawn from whitespace, ASCII, Latin-1/Latin Extended letters, digits,
symbols and a few CJK characters (characters whose case or class tables
differ between Java and Python are left out on purpose; see SURVEY §8)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textlab.functions import text as T

ALPHABET = (
    [chr(c) for c in range(0x20, 0x7F)]
    + [chr(c) for c in range(0xC0, 0x17F) if c not in (0xD7, 0xF7)]
    + list("\t\n\r\x0b\x0c  　 #_0123456789")
    + list("中文字ひらカナ€£¥©®°±")
)
texts = st.lists(st.text(alphabet=st.sampled_from(ALPHABET), max_size=60), min_size=1, max_size=150)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_text_functions_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id INT, text STRING")
    rows = df.orderBy("id").select(
        T.tokenize_ws("text").alias("ws"), T.tokenize_words("text").alias("words"),
        T.hashtag_count("text").alias("tags"), T.caps_word_count("text").alias("caps"),
        T.contains_link("text").alias("link"), T.text_length("text").alias("len")).collect()
    words = re.compile(r"\w+|[^\s\w]")
    for v, r in zip(values, rows):
        assert r.ws == v.split()
        assert r.words == words.findall(v)
        assert r.tags == len(re.findall(r"#\w+", v))
        assert r.caps == len([w for w in v.split() if w.isupper() and len(w) > 1])
        assert r.link == ("http://" in v or "https://" in v)
        assert r.len == len(v)
