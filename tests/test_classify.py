import json

from quire.operators.classify import PROMPT, rule_stub


def test_rules_read_the_whole_text():
    long = "Wort " * 1000
    labels = [json.loads(x)["label"] for x in rule_stub([PROMPT + long + "ISBN 978", PROMPT + long + "<item/>" * 5, PROMPT + long])]
    assert labels == ["imprint", "toc", "chapter"]
