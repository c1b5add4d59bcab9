"""State machines of packs and items, replayed over ordered commands, and what states mean for stages and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.operators.fold import folded

#: The transitions, as (command, result, from states).
PACK_MOVES = (
    ("start-processing", "processing", ("draft",)),
    ("require-review", "review-required", ("processing",)),
    ("record-partial-failure", "review-required", ("processing",)),
    ("mark-ready", "ready", ("processing",)),
    ("resolve-review", "ready", ("review-required",)),
    ("retry", "processing", ("review-required", "failed", "cancelled")),
    ("start-export", "exporting", ("ready",)),
    ("complete-export", "exported", ("exporting",)),
    ("fail", "failed", ("processing", "review-required", "ready", "exporting", "recovering")),
    ("cancel", "cancelled", ("processing", "review-required", "exporting", "recovering")),
    ("restart-packaging", "processing", ("ready", "exporting", "exported")),
    ("start-recovery", "recovering", ("processing", "exporting", "failed", "cancelled")),
    ("resume-recovery", "processing", ("recovering",)),
)
_ACTIVE = ("received", "imported", "extracted", "analyzed", "review-required", "reviewed", "recovering")
ITEM_MOVES = (
    ("mark-imported", "imported", ("received",)),
    ("mark-extracted", "extracted", ("imported",)),
    ("mark-analyzed", "analyzed", ("extracted",)),
    ("require-review", "review-required", ("analyzed",)),
    ("mark-reviewed", "reviewed", ("analyzed", "review-required")),
    ("mark-packaged", "packaged", ("reviewed",)),
    ("fail", "failed", _ACTIVE),
    ("cancel", "cancelled", _ACTIVE),
    ("retry", "received", ("failed", "cancelled")),
    ("invalidate-package", "reviewed", ("packaged",)),
    ("start-recovery", "recovering", ("imported", "extracted", "analyzed", "review-required", "reviewed", "failed", "cancelled")),
    ("resume-recovery", "received", ("recovering",)),
)
#: Stage, progress and the state that a stage is retried from.
STAGE_OF = {"received": "import", "imported": "extract", "extracted": "analyze", "analyzed": "review", "review-required": "review", "reviewed": "package", "packaged": "package"}
PROGRESS_OF = {"received": 0, "imported": 20, "extracted": 40, "analyzed": 60, "review-required": 70, "reviewed": 80, "packaged": 100}
PROGRESS_AT = {"import": 0, "extract": 20, "analyze": 40, "review": 60, "package": 80}
CHECKPOINT_OF = {"import": "received", "extract": "imported", "analyze": "extracted", "review": "analyzed", "package": "reviewed"}


def lookup(table: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def transition(moves: tuple, state: Column, command: Column) -> Column:
    """The state that follows, null where the command isn't allowed."""
    out = F.lit(None).cast("string")
    for name, to, sources in moves:
        out = F.when((command == name) & state.isin(*sources), F.lit(to)).otherwise(out)
    return out


def replay(commands: DataFrame, moves: tuple, start: str) -> DataFrame:
    """commands (key, seq, command) to key, state, rejected, commands: each key's commands in order of seq, such that aren't allowed left out.

    A fold, as a command's place depends on all before it; a task holds one key's state at a time, not its commands.
    Ties go by command.
    """
    table = {(source, name): to for name, to, sources in moves for source in sources}

    def step(state: tuple, r) -> tuple:
        to = table.get((state[0], r.command))
        return ((to, state[1]) if to else (state[0], state[1] + 1)), None

    kind = dict(commands.dtypes)["key"]
    return folded(commands.select("key", "seq", "command"), "key", ["seq", "command"], lambda: (start, 0), step, lambda key, state, n: (key, state[0], state[1], n), f"key {kind}, state string, rejected long, commands long")


def restore_checkpoint(state: Column, checkpoint: Column) -> Column:
    """The checkpoint that a failed, cancelled or recovering item goes back to, null where that isn't allowed."""
    ok = state.isin("failed", "cancelled", "recovering") & checkpoint.isin("received", "imported", "extracted", "analyzed", "reviewed")
    return F.when(ok, checkpoint)


def retry_stage(known: Column, has_original: Column, has_text: Column, has_findings: Column, state: Column) -> Column:
    stage = F.when(~has_original, "import").when(~has_text, "extract").when(~has_findings, "analyze").when(~state.isin("reviewed", "packaged"), "review").otherwise("package")
    return F.coalesce(known, stage)


def stage_and_progress(state: Column, retry: Column) -> Column:
    """struct<stage, progress> of an item; states without their own take those of the stage to retry."""
    return F.struct(F.coalesce(lookup(STAGE_OF, state), retry).alias("stage"), F.coalesce(lookup(PROGRESS_OF, state), lookup(PROGRESS_AT, retry)).cast("long").alias("progress"))


def claim_run(runs: DataFrame, expected: Column, session: str, now_ms: int, ttl_ms: int) -> DataFrame:
    """runs (status, claim_version, session_id, deadline_ms, ...) after session tried to claim each at the claim version it expects, with claimed.

    Runs that wait can be claimed, and running ones whose claim is over, was never given, or is another session's. A
    claim raises the version, so whoever held the run before is fenced off.
    """
    lapsed = F.col("session_id").isNull() | (F.col("session_id") != session) | F.col("deadline_ms").isNull() | (F.col("deadline_ms") <= now_ms)
    ok = F.coalesce((F.col("claim_version") == expected) & (F.col("status").isin("queued", "recovering") | ((F.col("status") == "running") & lapsed)), F.lit(False))
    sets = {"status": F.lit("running"), "session_id": F.lit(session), "deadline_ms": F.lit(now_ms + ttl_ms).cast("long"), "claim_version": (F.col("claim_version") + 1).cast("long")}
    return runs.withColumn("claimed", ok).withColumns({c: F.when(ok, v).otherwise(F.col(c)) for c, v in sets.items()})


def settle_run(runs: DataFrame, action: Column, session: str, now_ms: int, ttl_ms: int, at: str) -> DataFrame:
    """runs after session's action on each (renew, checkpoint, complete or fail), with accepted.

    Only a live claim of the session takes an action. renew moves the deadline; complete and fail end the run and drop
    the claim; instants never go back.
    """
    live = F.coalesce((F.col("status") == "running") & (F.col("session_id") == session) & (F.col("deadline_ms") > now_ms), F.lit(False))
    ends = live & action.isin("complete", "fail")
    status = F.when(live & (action == "complete"), "succeeded").when(live & (action == "fail"), "failed").otherwise(F.col("status"))
    deadline = F.when(ends, F.lit(None)).when(live & (action == "renew"), now_ms + ttl_ms).otherwise(F.col("deadline_ms")).cast("long")
    updated = F.when(live, F.greatest("updated_at", F.lit(at))).otherwise(F.col("updated_at"))
    out = runs.withColumn("accepted", live)
    return out.withColumns({"status": status, "deadline_ms": deadline, "session_id": F.when(~ends, F.col("session_id")), "updated_at": updated})
