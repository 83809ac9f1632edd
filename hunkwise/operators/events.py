"""Event intake: signature audit, payload validation, disposition, review context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions import variant as V
from hunkwise.functions.steps import computed_once
from hunkwise.functions.hmac import hmac_sha256_hex

# The event type, actions and signature scheme that are handled.
HANDLED_EVENT = "pull_request"
HANDLED_ACTIONS = ["opened", "synchronize", "reopened"]
SIGNATURE_SCHEME = "sha256"
DISPOSITIONS = [
    "missing", "malformed", "mismatch", "ignored_event", "invalid_payload", "ignored_action", "accepted",
]
MAX_URL_CHARS = 2083

_URL = r"\A(?i:(https?)://)((?:[^\s/?#@]*@)?)([^\s/?#@:]+|\[[0-9a-fA-F:.]+\])(?::([0-9]{1,5}))?([^\s]*)\z"
_REPO_FIELDS = (("id", "int"), ("name", "text"), ("full_name", "text"), ("clone_url", "url"))

# the payload fields read; each leaf stays a VARIANT, so that its JSON type is known
_REPO_DDL = "struct<id variant, name variant, full_name variant, clone_url variant, default_branch variant>"
_REF_DDL = "struct<sha variant, ref variant, repo variant>"
PAYLOAD_DDL = f"""struct<
    action variant, number variant,
    pull_request struct<
        number variant, title variant, body variant, state variant, head {_REF_DDL}, base {_REF_DDL},
        user struct<login variant, id variant>, html_url variant, diff_url variant, patch_url variant,
        additions variant, deletions variant, changed_files variant>,
    repository {_REPO_DDL}, sender struct<login variant, id variant>, installation variant>"""


def signature_digest(signature: Column) -> Column:
    """What follows the first ``=`` of the header."""
    return F.try_element_at(F.split(signature, "=", 2), F.lit(2))


def signature_state(signature: Column, body: Column, secret: str) -> Column:
    """``missing``, ``malformed``, ``mismatch`` or ``valid``, in that order."""
    scheme = F.try_element_at(F.split(signature, "=", 2), F.lit(1))
    return (
        F.when(F.coalesce(signature, F.lit("")) == "", "missing")
        .when((scheme != SIGNATURE_SCHEME) | signature_digest(signature).isNull(), "malformed")
        .when(signature_digest(signature) != hmac_sha256_hex(secret, body), "mismatch")
        .otherwise("valid")
    )


def is_http_url(url: Column) -> Column:
    return url.rlike(_URL) & (F.length(url) <= MAX_URL_CHARS)


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, and ``/`` where the path is empty."""
    scheme, host = F.lower(F.regexp_extract(url, _URL, 1)), F.lower(F.regexp_extract(url, _URL, 3))
    port, rest = F.regexp_extract(url, _URL, 4), F.regexp_extract(url, _URL, 5)
    default_port = F.when(scheme == "http", "80").otherwise("443")
    return F.concat(
        scheme, F.lit("://"), F.regexp_extract(url, _URL, 2), host,
        F.when((port == "") | (port == default_port), "").otherwise(F.concat(F.lit(":"), port)),
        F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)),
    )


def payload_text(body: Column) -> Column:
    """The body as text, or NULL when it is not UTF-8."""
    text = body.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def _required(leaf: Column, what: str) -> Column:
    if what == "int":
        return V.integer(leaf).isNotNull()
    value = V.text(leaf)
    return F.coalesce(is_http_url(value), F.lit(False)) if what == "url" else value.isNotNull()


def _optional(leaf: Column, what: str) -> Column:
    return leaf.isNull() | _required(leaf, what)


def _valid_repo(repo: Column) -> Column:
    ok = repo.isNotNull() & _optional(repo["default_branch"], "text")
    for name, what in _REPO_FIELDS:
        ok = ok & _required(repo[name], what)
    return ok


def _absent(leaf: Column) -> Column:
    return leaf.isNull() | V.is_null(leaf)


def installation_id(payload: Column) -> Column:
    return V.integer(F.try_variant_get(payload["installation"], "$.id", "variant"))


def is_valid_payload(payload: Column) -> Column:
    """All required fields present with their types; optional ones right where given."""
    pr = payload["pull_request"]
    ok = payload.isNotNull()
    for leaf, what in [
        (payload["action"], "text"), (payload["number"], "int"),
        (pr["number"], "int"), (pr["title"], "text"), (pr["state"], "text"),
        (pr["head"]["sha"], "text"), (pr["head"]["ref"], "text"), (pr["base"]["sha"], "text"), (pr["base"]["ref"], "text"),
        (pr["user"]["login"], "text"), (pr["user"]["id"], "int"),
        (pr["html_url"], "url"), (pr["diff_url"], "url"), (pr["patch_url"], "url"),
        (payload["sender"]["login"], "text"), (payload["sender"]["id"], "int"),
    ]:
        ok = ok & _required(leaf, what)
    ok = ok & _valid_repo(payload["repository"]) & (_absent(pr["body"]) | _required(pr["body"], "text"))
    for name in ["additions", "deletions", "changed_files"]:
        ok = ok & _optional(pr[name], "int")
    for side in ["head", "base"]:
        repo = pr[side]["repo"]
        ok = ok & (_absent(repo) | _valid_repo(V.as_(repo, _REPO_DDL)))
    return ok & (_absent(payload["installation"]) | installation_id(payload).isNotNull())


def with_disposition(events: DataFrame, secret: str) -> DataFrame:
    """Adds ``payload`` (struct of VARIANT leaves) and ``disposition``. The signature is judged before anything else, the
    payload before the action. Bad rows stay as rows: nothing raises."""
    V.last_key_wins(events)
    state = signature_state(F.col("signature"), F.col("body"), secret)
    known = computed_once(events, "signature_state", state)
    judged = (F.col("signature_state") == "valid") & (F.col("event_type") == HANDLED_EVENT)
    text = F.when(judged, payload_text(F.col("body")))
    parsed = computed_once(known, "payload", V.parse_as(text, PAYLOAD_DDL))
    disposition = (
        F.when(F.col("signature_state") != "valid", F.col("signature_state"))
        .when(F.coalesce(F.col("event_type") != HANDLED_EVENT, F.lit(True)), "ignored_event")
        .when(~F.coalesce(is_valid_payload(F.col("payload")), F.lit(False)), "invalid_payload")
        .when(~V.text(F.col("payload.action")).isin(HANDLED_ACTIONS), "ignored_action")
        .otherwise("accepted")
    )
    return computed_once(parsed, "disposition", disposition).drop("signature_state")


def disposition_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("disposition").agg(F.count(F.lit(1)).alias("deliveries"))


def review_contexts(judged: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Accepted deliveries as review contexts. The author is the event's sender."""
    p = F.col("payload")
    pr = p["pull_request"]

    def count(name: str) -> Column:
        return F.coalesce(V.integer(pr[name]), F.lit(0)).alias(name)

    return judged.where("disposition = 'accepted'").select(
        *(extra or []),
        installation_id(p).alias("installation_id"),
        V.text(p["repository"]["full_name"]).alias("repo_full_name"),
        normal_url(V.text(p["repository"]["clone_url"])).alias("repo_clone_url"),
        V.integer(pr["number"]).alias("pr_number"),
        V.text(pr["title"]).alias("pr_title"),
        V.text(pr["head"]["sha"]).alias("head_sha"),
        V.text(pr["head"]["ref"]).alias("head_branch"),
        V.text(pr["base"]["ref"]).alias("base_branch"),
        V.text(p["sender"]["login"]).alias("author_login"),
        count("additions"), count("deletions"), count("changed_files"),
    )
