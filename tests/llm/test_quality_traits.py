from graphloom.llm.quality_model import _shape, hashed, traits, votes


def words(n):
    return [f"word{chr(97 + k % 26)}{k}" for k in range(n)]


def test_diversity_reads_the_whole_text():
    head = words(200)
    t = traits(" ".join(head + ["same"] * 5000))
    assert t["kinds"] < 0.1 and votes(t)[8] == 2
    t = traits(" ".join(["same"] * 200 + words(5000)))
    assert t["kinds"] > 0.9 and votes(t)[8] == 1
    assert traits(" ".join(head + ["same"] * 150))["kinds"] < 0.7  # the last window, which isn't full by itself


def test_diversity_does_not_fall_with_length():
    shares = [traits(" ".join((words(150) * 100)[:n]))["kinds"] for n in (200, 400, 1000, 4400, 9999)]
    assert max(shares) - min(shares) < 1e-9
    assert traits("a b a b")["kinds"] == 0.5


def test_words_are_shaped_whole():
    assert _shape("a" * 30 + "$1") == "a$0"
    long = "x" * 24
    a, b = (set(hashed(w, traits("word"))[0].tolist()) for w in (long + "Y1#ab", long + "ab"))
    assert a != b
