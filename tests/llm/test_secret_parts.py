"""Credentials inside longer runs of credential characters."""

from tidewrack.llm import secrets


def test_prefixed_and_suffixed_credentials():
    scorer = secrets.Scorer()
    credentials, ordinary = secrets.labelled(seed=78, each=20)
    for before, after in (("export GH=", ""), ("https://host.example/x/", ""), ("?key=", ""), ("npmAuth=", "/v1/list"), ("https://host.example/a.", "=")):
        for name in ("hosting-token", "cloud-key", "chat-token", "package-token", "payment-key"):
            hits = 0
            for x in credentials[name]:
                text = before + x + ("" if name == "cloud-key" and after == "=" else after)
                hits += any(text[s:e] == x for s, _, e in secrets.scan(text, scorer)[1])
            assert hits >= 0.8 * len(credentials[name]), (name, before, after, hits)
    two = "a=" + credentials["package-token"][0] + "/" + credentials["hosting-token"][0]
    assert len(secrets.scan(two, scorer)[1]) == 2
    assert sum(len(secrets.scan(s, scorer)[1]) for s in ordinary) <= 0.02 * len(ordinary)
