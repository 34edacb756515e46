"""Surrogates of values with nothing to replace, and of kinds whose space of draws is small."""

from entwine.llm import pii

KEY = b"test"


def test_masks_and_small_spaces(spark):
    mails = [f"{chr(97 + k)}@d.com" for k in range(26)]
    texts = ["password: ********", "token=------", "password: ١٢٣٤٥٦", *[f"write to {m} now" for m in mails]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.replace_entities(docs, KEY).collect()}
    assert [out[k]["text"] for k in (0, 1)] == texts[:2] and [out[k]["n_entities"] for k in range(3)] == [0, 0, 1]
    assert out[2]["text"] != texts[2]
    new = [out[k]["entities"][0]["surrogate"] for k in range(3, 29)]
    assert len(set(new)) == 26 and not set(new) & set(mails)
    assert len({m.split("@")[1] for m in new}) == 1 and "d.com" not in new[0]


def test_space_grows_with_attempt():
    values = {"email": "A@d.com", "ssn": "123456789", "card": "4111111111111111", "phone": "4155550100", "iban": "DE89370400440532013000", "ip": "1.2.3.4", "secret": "abc123"}
    for kind, value in values.items():
        short, long = pii.surrogate(KEY, kind, value, 0), pii.surrogate(KEY, kind, value, 16)
        mention = pii.render(kind, value, long)
        assert len(long) > len(short) - 4 * (kind == "ip") and mention.lower() == long.lower()
    assert pii.luhn(pii.surrogate(KEY, "card", values["card"], 16)) == 0 and pii.iban_ok(pii.surrogate(KEY, "iban", values["iban"], 16))
