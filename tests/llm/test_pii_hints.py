"""The shortcut of find() skips no text that holds an entity."""

import pytest

from entwine.llm import pii


@pytest.mark.parametrize("secret", ["xoxb-abcdefghijkl", "sk-" + "a" * 24, "AKIA" + "B" * 16, "ASIA" + "C" * 16, *[f"gh{c}_" + "d" * 24 for c in "pousr"]])
def test_key_prefixes_need_no_digit(monkeypatch, secret):
    text = f"use {secret} for it"
    found = pii.find(text)
    monkeypatch.setattr(pii, "hints", lambda text: True)
    assert found == pii.find(text) and [x[3] for x in found] == [secret]
