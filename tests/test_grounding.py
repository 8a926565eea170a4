import pytest

from captide.functions.grounding import grounded, reversed_at


@pytest.mark.parametrize(
    ("source", "claim", "turned"),
    [
        ("He did not attack the village", "He attacks the village", True), ("He did not attack the village", "He did not attack anyone", False), ("Don't you see? do not attack!", "He attacks", False),
        ("please do not attack them", "He attacks", False), ("did not attack, later attacked again", "He attacks", False), ("он не нападает на них", "Он нападает на них", True),
        ("not run", "runs", False), ("", "x", False), (None, "x", False), ("never threatened her", None, False), ("never threatened her", "he threatens her", True),
    ],
)
def test_negation_turned_round(source, claim, turned):
    assert (reversed_at(source, claim) is not None) is turned


def test_quote_replaces_the_claim():
    source = "a" * 60 + " he never attacked anybody " + "b" * 90
    out = grounded(source, "he attacked them")
    assert out.startswith("В субтитрах: «…") and out.endswith("…»") and "never attacked" in out
    assert grounded("he never attacked", "he slept") == "he slept" and grounded(None, None) is None
