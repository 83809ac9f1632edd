"""Labelled findings made by rule, from which the forest of ``secrets`` learns beside the findings of a corpus.

Each form states how a value is drawn and what stands before it. Issuers' published key forms and values assigned to the
names of secrets are label 1; digests, ids, numbers, paths, names, dates and placeholders are label 0. ``issued`` and
``public`` recognise forms by evidence that the features do not hold: an issuer's own prefix, and the exact lengths and
groups of digests and UUIDs. The rows depend on the seed and the filler words only, so a form is judged alike in every corpus.
"""

from __future__ import annotations

import random
import re
import string

#: Lines made for each pair of form and introduction.
LINES = 40

#: Key forms that issuers publish.
_ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[sr]k_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_\-]{35}"
                     r"|eyJ[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]{10,}){1,2}")
_PUBLIC = re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}"
                     r"|(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")

_HEX, _ALNUM, _CAPS = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
#: Names that introduce secrets, and ones that introduce other values; words that stand in for other text.
_NAMES = ("token", "api_key", "password", "client_secret", "AWS_SECRET_ACCESS_KEY", "DB_PASSWORD", "auth_token", "private_key", "passwd", "secret")
_PLAIN_NAMES = ("id", "name", "title", "path", "url", "etag", "trace_id", "build", "image", "layer", "file", "state", "color", "label", "sha256", "commit", "digest", "uuid")
_FILLER = ("north", "river", "little", "paper", "window", "garden", "seven", "letter", "under", "market", "silver", "bridge")
_PLACEHOLDERS = ("changeme", "your_token_here", "your-api-key", "xxxxxxxxxxxxxxxx", "placeholder", "REPLACE_ME", "********", "example", "${SECRET_TOKEN}", "<your-password>",
                 "os.environ", "getenv", "undefined")


def issued(value: str) -> bool:
    """Whether the value has an issuer's published key form."""
    return _ISSUED.fullmatch(value) is not None


def public(value: str) -> bool:
    """Whether the value has the exact form of a digest or UUID."""
    return _PUBLIC.fullmatch(value) is not None


def lines(words: list[str], seed: int = 11, each: int = LINES) -> list[tuple[int, str, int, int]]:
    """(label, text, start, end): made lines with the place of the labelled value. ``words`` are used as the text around."""
    rng = random.Random(seed)
    filler = words if len(words) >= len(_FILLER) else [*words, *_FILLER]

    def some(alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high or low)))

    def digest() -> str:
        value = some(_HEX, rng.choice((32, 40, 64)))
        return value.upper() if rng.random() < 0.2 else value

    def uuid() -> str:
        return "-".join(some(_HEX, n) for n in (8, 4, 4, 4, 12))

    def word() -> str:
        return rng.choice(filler)

    def password() -> str:
        parts = [word()[: rng.randint(3, 8)], some(string.digits, 1, 4), some("!@#$%&*._-", 0, 3), some(string.ascii_letters, 0, 6)]
        rng.shuffle(parts)
        value = "".join(parts)
        return value if len(value) >= 6 else value + some(string.digits, 6 - len(value))

    def joined() -> str:
        kind, parts = rng.randrange(4), [word() for _ in range(rng.randint(2, 5))]
        if kind == 0:
            parts = [p.capitalize() for p in parts]
        value = ("", "_", "-", "/")[kind].join(parts)
        return value + (some(string.digits, 1, 3) if rng.random() < 0.3 else "")

    keys = (
        lambda: rng.choice(("AKIA", "ASIA")) + some(_CAPS, 16),
        lambda: rng.choice(("ghp_", "gho_", "ghs_")) + some(_ALNUM, 36),
        lambda: rng.choice(("sk_live_", "rk_live_")) + some(_ALNUM, 24, 48),
        lambda: "AIza" + some(_ALNUM + "_-", 35),
        lambda: "eyJ" + some(_ALNUM, 17, 40) + "." + some(_ALNUM + "_-", 30, 120) + "." + some(_ALNUM + "_-", 43),
        lambda: some(string.ascii_lowercase, 2, 6) + rng.choice("_-.") + some(_ALNUM, 18, 48),
    )
    assigned_keys = (digest, uuid, password, lambda: some(_ALNUM + "/+", 20, 64), lambda: some(_ALNUM, 12, 40))
    others = (
        digest, uuid, joined, joined,
        lambda: some(string.digits, 6, 20),
        lambda: f"20{some(string.digits, 2)}-0{rng.randint(1, 9)}-1{some(string.digits, 1)}T1{some(string.digits, 1)}:{some('012345', 1)}0:00",
        lambda: f"v{some(string.digits, 1)}.{some(string.digits, 1, 2)}.{some(string.digits, 1, 3)}-{rng.choice(('rc1', 'beta2', 'SNAPSHOT'))}",
        lambda: f"{word().upper()}-20{some(string.digits, 2)}-{some(string.digits, 4, 8)}",
        lambda: f"{some(string.ascii_uppercase, 2)}{some(string.digits, 14, 20)}",
        lambda: f"https://{word()}.org/{word()}/{some(string.digits, 2, 6)}",
        lambda: f"{rng.choice(('sha384', 'sha512', 'sha256'))}-{some(_ALNUM + '+/', 43, 86)}",
        lambda: f"{word()}-{some(_HEX, 8, 10)}-{some(string.ascii_lowercase + string.digits, 5)}",
        lambda: f"/{word()}/{word()}/{word()}.{rng.choice(('txt', 'py', 'json'))}",
        lambda: "0x" + some(_HEX, 16),
    )
    around = (lambda v: f"{word()} {word()} ", "", ""), (lambda v: f"{rng.choice(_PLAIN_NAMES)} ", "", "")

    def assigned(names: tuple[str, ...], quoted: bool):
        def before(value: str) -> str:
            name = rng.choice(names) if rng.random() < 0.8 or names is _NAMES else word()
            return f"{word()} {name}{rng.choice((' = ', '=', ': ', ' => '))}"

        return before, *(('"', '"') if quoted else ("", ""))

    header = (lambda v: f"{word()} Authorization: {rng.choice(('Bearer', 'Basic', 'Token'))} "), "", ""
    secret, plain = [assigned(_NAMES, q) for q in (True, False)], [assigned(_PLAIN_NAMES, q) for q in (True, False)]
    plans = [(1, form, way) for form in keys for way in (*around, *secret, *plain, header)]
    plans += [(1, form, way) for form in assigned_keys for way in (*secret, *secret)]
    plans += [(1, form, header) for form in assigned_keys if form is not password]
    plans += [(0, form, way) for form in others for way in (*around, *around, *plain)]
    plans += [(0, lambda: rng.choice(_PLACEHOLDERS), way) for way in secret]
    out = []
    for label, form, (before, opening, closing) in plans:
        for _ in range(each):
            value = form()
            start = before(value) + opening
            out.append((label, f"{word()} {start}{value}{closing} {word()} {word()}", len(f"{(start)}"), len(value)))
    return [(label, text, at, at + n) for label, text, at, n in ((lab, txt, txt.index(" ") + 1 + s, n) for lab, txt, s, n in out)]
