"""Members and one-time codes.

The reference handles one request at a time; here a request table is applied
as a batch. Later requests for the same phone win (W2). Attempts are checked
either against the code table as it stands after the request batch
(``otp_attempts_checked``) or, from a log of requests and attempts, against the
code that stood when each attempt was made (``otp_attempts_as_of``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kipmart.functions import text as X
from kipmart.operators.changes import with_defaults
from kipmart.plans.materialize import write_temp_table
from kipmart.plans.scan import asof_join, running_last, sorted_parts
from kipmart.plans.upsert import latest_per_key, upsert

OTP_TTL_MINUTES = 5
OTP_REARM_MINUTES = 10


def latest_otp_per_phone(requests: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Keyed upsert of codes; one row per phone, the latest request wins and
    expires ``OTP_TTL_MINUTES`` after it was made. ``base`` (phone, otp,
    expires_at) keeps the phones with no new request."""
    r = (requests.withColumn("phone", X.phone_no_blanks(F.col("phone")))
         .filter(F.col("phone") != ""))
    latest = latest_per_key(r.select("phone", "otp", "requested_at", "seq"), ["phone"])
    new = latest.select("phone", "otp",
                        (F.col("requested_at") + F.expr(f"INTERVAL {OTP_TTL_MINUTES} MINUTES"))
                        .alias("expires_at"))
    if base is None:
        return new
    kept = base.join(new.select("phone"), "phone", "left_anti")
    return kept.select("phone", "otp", "expires_at").unionByName(new)


def otp_attempts_checked(otps: DataFrame, attempts: DataFrame) -> DataFrame:
    """U4: an attempt is valid when the code table holds the same phone and
    code and it has not expired at the attempt time; malformed input (empty
    phone, code not 6 characters) is invalid without a lookup."""
    a = attempts.withColumn("phone", X.phone_no_blanks(F.col("phone")))
    o = otps.select("phone", "otp", "expires_at")
    j = a.join(o, ["phone", "otp"], "left")
    ok_input = (F.col("phone") != "") & (F.length(F.trim(F.col("otp"))) == 6)
    valid = ok_input & F.coalesce(F.col("expires_at") > F.col("attempted_at"), F.lit(False))
    return j.select("seq", "phone", "otp", "attempted_at", valid.alias("valid"))


def otps_remaining(otps: DataFrame, checked: DataFrame) -> DataFrame:
    """A successful verification deletes the phone's code."""
    used = checked.filter("valid").select("phone").distinct()
    return otps.join(used, "phone", "left_anti")


def otps_rearmed(otps: DataFrame, checked: DataFrame, at_col: str = "attempted_at") -> DataFrame:
    """U4 (register/reset): a verified code gets ``OTP_REARM_MINUTES`` more from
    the (latest) successful attempt."""
    ok = (checked.filter("valid").groupBy("phone")
          .agg(F.max(at_col).alias("__at")))
    j = otps.join(ok, "phone", "left")
    return j.select("phone", "otp", F.when(F.col("__at").isNotNull(),
                                           F.col("__at") + F.expr(f"INTERVAL {OTP_REARM_MINUTES} MINUTES"))
                    .otherwise(F.col("expires_at")).alias("expires_at"))


def _minutes(n: int):
    return F.expr(f"INTERVAL {n} MINUTES")


def _first_of(matches: DataFrame, code: str, time: str) -> DataFrame:
    """(code, first): the earliest matching attempt at each code; it uses the
    code up."""
    return matches.groupBy(code).agg(F.min(F.struct(time, "seq")).alias("__first"))


def otp_attempts_as_of(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """U1/U4 in the order of events: every attempt is checked against the code
    that stood at that moment.

    The phone's last request not after the attempt gives its code (``code_seq``,
    null without one) and its expiry. The first attempt that matches it before it
    expires is valid and deletes it, so later attempts at the same code are not.
    At equal times a request comes before an attempt, and lower ``seq`` first.
    Malformed input (no phone, code not 6 characters) is invalid and uses nothing
    up. A phone with a third of all events lies over several tasks
    (:mod:`kipmart.plans.scan`); the code's first match is a grouped minimum."""
    r = (requests.withColumn("phone", X.phone_no_blanks(F.col("phone"))).filter(F.col("phone") != "")
         .select("phone", F.col("requested_at").alias("at"), "seq", F.trim("otp").alias("otp"),
                 F.col("seq").alias("code_seq"), (F.col("requested_at") + _minutes(OTP_TTL_MINUTES)).alias("expires_at")))
    a = attempts.withColumn("phone", X.phone_no_blanks(F.col("phone"))) \
        .select("seq", "phone", "otp", F.col("attempted_at").alias("at"))
    j = asof_join(a, r, ["phone"], ["at", "seq"], "code")
    otp = F.trim("otp")
    hit = (F.length(otp) == 6) & (F.col("code.otp") == otp) & (F.col("code.expires_at") > F.col("at"))
    j = write_temp_table(j.select("seq", "phone", "otp", "at", F.col("code.code_seq").alias("code_seq"),
                                  F.coalesce(hit, F.lit(False)).alias("hit")), "kipmart-asof")
    first = _first_of(j.filter("hit"), "code_seq", "at").select("code_seq", F.col("__first.seq").alias("first"))
    return (j.join(first, "code_seq", "left")
            .select("seq", "phone", "otp", F.col("at").alias("attempted_at"), "code_seq",
                    (F.col("hit") & F.coalesce(F.col("first") == F.col("seq"), F.lit(False))).alias("valid")))


def otps_after_log(requests: DataFrame, checked: DataFrame) -> DataFrame:
    """U5 after a whole log: each phone's last code (by time, then ``seq``), unless
    an attempt of :func:`otp_attempts_as_of` used it up."""
    r = requests.withColumn("phone", X.phone_no_blanks(F.col("phone"))).filter(F.col("phone") != "")
    last = r.groupBy("phone").agg(F.max(F.struct(F.col("requested_at").alias("at"), "seq", "otp")).alias("r"))
    used = checked.filter("valid").select(F.col("code_seq").alias("seq"))
    return (last.select("phone", "r.*").join(used, "seq", "left_anti")
            .select("phone", "otp", (F.col("at") + _minutes(OTP_TTL_MINUTES)).alias("expires_at")))


def otp_tokens_issued(checked: DataFrame) -> DataFrame:
    """U4: a valid attempt of a registration or reset stores a token for its phone
    and re-arms the row. The token is a text of the attempt's number (the
    reference draws it at random)."""
    return checked.filter("valid").select("phone", F.col("attempted_at").alias("issued_at"), "seq",
                                          F.concat(F.lit("T"), F.col("seq").cast("string")).alias("token"))


def otp_tokens_checked(requests: DataFrame, issued: DataFrame, attempts: DataFrame) -> DataFrame:
    """U4, token form: completing a registration or reset. A token is valid if it
    is the phone's last one, the row's expiry at that moment is later, and no
    completion has used it before. The expiry is set by the last event of the
    phone: a request (5 minutes) or an issued token (10 minutes). ``attempts``:
    seq, phone, token, attempted_at. At equal times requests come first, then
    tokens, then attempts."""
    digits = X.phone_digits(X.php_trim(F.col("phone")))
    sent = requests.withColumn("phone", digits).filter(F.col("phone") != "").select(
        "phone", F.col("requested_at").alias("at"), F.lit(0).alias("kind"), "seq",
        F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("given"))
    armed = issued.withColumn("phone", digits).select(
        "phone", F.col("issued_at").alias("at"), F.lit(1).alias("kind"), "seq", "token",
        F.lit(None).cast("string").alias("given"))
    asked = attempts.withColumn("phone", digits).select(
        "phone", F.col("attempted_at").alias("at"), F.lit(2).alias("kind"), "seq",
        F.lit(None).cast("string").alias("token"), X.php_trim(F.col("token")).alias("given"))
    parts = sorted_parts(sent.unionByName(armed).unionByName(asked), ["phone"], [F.col("at"), F.col("kind"), F.col("seq")])
    kind = F.col("kind")
    expires = F.when(kind == 0, F.col("at") + _minutes(OTP_TTL_MINUTES)).when(
        kind == 1, F.col("at") + _minutes(OTP_REARM_MINUTES))
    out = running_last(parts, ["phone"], expires, "__expires")
    out = running_last(out, ["phone"], F.when(kind == 1, F.struct("token", "seq")), "__issued").filter(kind == 2)
    hit = (F.col("phone") != "") & (F.col("given") != "") & (F.col("__issued.token") == F.col("given")) \
        & (F.col("__expires") > F.col("at"))
    out = write_temp_table(out.select("seq", "phone", F.col("given").alias("token"), "at",
                                      F.col("__issued.seq").alias("issue_seq"),
                                      F.coalesce(hit, F.lit(False)).alias("hit")), "kipmart-tokens")
    first = _first_of(out.filter("hit"), "issue_seq", "at").select("issue_seq", F.col("__first.seq").alias("first"))
    return (out.join(first, "issue_seq", "left")
            .select("seq", "phone", "token", F.col("at").alias("attempted_at"), "issue_seq",
                    (F.col("hit") & F.coalesce(F.col("first") == F.col("seq"), F.lit(False))).alias("valid")))


def _request_phone(df: DataFrame) -> DataFrame:
    return df.withColumn("phone", X.phone_digits(X.php_trim(F.col("phone"))))


def known_phone_requests(requests: DataFrame, members: DataFrame) -> DataFrame:
    """login/reset code requests are served only for registered phones of
    at least 8 digits."""
    r = _request_phone(requests).filter(F.length("phone") >= 8)
    return r.join(members.select("phone"), "phone", "left_semi")


def new_phone_requests(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Register requests are served only for phones not yet registered."""
    r = _request_phone(requests).filter(F.length("phone") >= 8)
    return r.join(members.select("phone"), "phone", "left_anti")


UPSERTED = ["shipping_company", "member_number"]


def members_upserted(members: DataFrame, changes: DataFrame, start_id: int | None = None) -> DataFrame:
    """Upsert by unique phone. Known phones get the latest carrier and
    member number; unknown phones are inserted with new ids, numbered in the
    order of their first request after the current highest id. Requests without
    a phone are refused. If the requests have ``changed_at``, ``updated_at`` is the time
    of the last one that changed something: inserted the row, or set a value
    other than the one that stood then (requests in ``seq`` order)."""
    ch = changes.withColumn("phone", X.phone_no_blanks(F.col("phone"))).filter(F.col("phone") != "")
    out = upsert(members.select("id", "phone", "name", *UPSERTED), ch, ["phone"], UPSERTED, start_id=start_id)
    if "changed_at" not in changes.columns:
        return out
    base = with_defaults(members, {"updated_at": ("timestamp_ntz", None)}).select("phone", "updated_at", F.struct(*UPSERTED).alias("__base"))
    values = F.struct(*UPSERTED)
    given = ch.select("phone", "seq", "changed_at", values.alias("now"))
    # the request before: places are doubled, so a request looks just before itself
    seen = asof_join(given.withColumn("at", 2 * F.col("seq") - 1), given.select("phone", (2 * F.col("seq")).alias("at"), "now"),
                     ["phone"], ["at"], "last").join(base.select("phone", "__base"), "phone", "left")
    stood = F.coalesce(F.col("last.now"), F.col("__base"))
    moved = F.when(stood.isNull() | ~stood.eqNullSafe(F.col("now")), F.col("seq"))
    times = seen.groupBy("phone").agg(F.max_by("changed_at", moved).alias("__at"))
    return out.join(times, "phone", "left").join(base.select("phone", "updated_at"), "phone", "left") \
        .select("id", "phone", "name", *UPSERTED, F.coalesce("__at", "updated_at").alias("updated_at"))


def member_display_name(members: DataFrame) -> DataFrame:
    """``name ?: phone``."""
    return members.select("id", X.first_truthy("name", "phone").alias("display_name"))


def member_initials(members: DataFrame) -> DataFrame:
    """T19."""
    return members.select("id", X.initial(F.col("name"), F.col("phone")).alias("initial"))

