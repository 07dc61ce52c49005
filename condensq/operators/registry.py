"""Run registry, task state and resumable work."""

from __future__ import annotations

import os
import signal
import subprocess
import sys
import threading
from collections.abc import Callable, Iterator, Sequence
from multiprocessing import Pipe

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensq.operators.ranking import latest_per_key
from condensq.schemas import RUN


# Runs ----------------------------------------------------------------------------------------

def log_run(
    spark: SparkSession, path: str, run: str, ts: str, params: dict, metrics: dict, tags: dict
) -> None:
    """Append one run; maps keep the registry schema fixed."""
    row = (
        run, ts, {k: str(v) for k, v in params.items()},
        {k: float(v) for k, v in metrics.items() if v is not None},
        {k: str(v) for k, v in tags.items()},
    )
    raw = "run string, ts string, params map<string,string>, metrics map<string,double>, " \
          "tags map<string,string>"
    spark.createDataFrame([row], raw).withColumn("ts", F.to_timestamp("ts")).select(
        *RUN.names
    ).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).parquet(path)


def compare_runs(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per run with the chosen metrics as columns."""
    return runs.select(
        "run", "ts", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics]
    )


def metrics_long(runs: DataFrame) -> DataFrame:
    return runs.select("run", F.explode("metrics").alias("metric", "value"))


def run_history(metric_rows: DataFrame, phases: DataFrame) -> DataFrame:
    """Metric rows of all runs in phase order. phases: run, phase, phase_order, notes."""
    return metric_rows.join(phases, "run", "left").orderBy(
        "phase_order", "run", "split"
    )


# Task state ----------------------------------------------------------------------------------

def latest_state(state: DataFrame) -> DataFrame:
    """Newest row per task."""
    return latest_per_key(state, ["key"], ["timestamp"])


def pending_work(
    work: DataFrame, state: DataFrame, retry_failed: bool = False, error_like: str | None = None,
    tiers: Sequence[int] | None = None, limit: int | None = None,
) -> DataFrame:
    """Tasks still to run: not completed; failed ones only on request, by error text if given."""
    todo = work.where("status_in = 'computed'") if "status_in" in work.columns else work
    if tiers is not None:
        todo = todo.where(F.col("tier").isin(list(tiers)))
    if limit is not None:
        todo = todo.orderBy("key").limit(limit)
    known = latest_state(state).select(
        "key", F.col("status").alias("_s"), F.coalesce("error", F.lit("")).alias("_e")
    )
    done = F.col("_s") == "completed"
    failed = F.col("_s") == "failed"
    skip = done | (failed if not retry_failed else F.lit(False))
    if retry_failed and error_like:
        skip = skip | (failed & ~F.col("_e").contains(error_like))
    return todo.join(known.where(skip).select("key"), "key", "left_anti")


def state_rows(results: DataFrame, now=None) -> DataFrame:
    """State rows to append after a run; earlier rows stay."""
    stamp = F.current_timestamp() if now is None else F.lit(now)
    return results.select(
        "key",
        F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"),
        F.coalesce("n_conformations", F.lit(0)).cast("long").alias("n_conformations"),
        F.col("runtime_sec").cast("double").alias("runtime_sec"),
        "error",
        stamp.cast("string").alias("timestamp"),
    )


# What the logs of the sampling program say.
_FILTERED = r"Filtered \d+ samples down to (\d+)"
_FINISHED = "Completed"
_KNOWN_ERRORS = {"unphysical_filter_bug": "Invalid suffix '_unphysical.xtc'"}
# Fixed values end.


def parse_run_logs(df: DataFrame, text: str = "log", exit_code: str = "exit_code") -> DataFrame:
    """Samples left after filtering (-1: finished, number unknown; 0: none) and error class."""
    log = F.coalesce(F.col(text), F.lit(""))
    n = F.regexp_extract(log, _FILTERED, 1).try_cast("long")
    error = F.concat(F.lit("exit_code="), F.col(exit_code).cast("string"))
    for name, mark in _KNOWN_ERRORS.items():
        error = F.when(log.contains(mark), F.lit(name)).otherwise(error)
    return df.withColumns(
        {
            "n_conformations": F.coalesce(
                n, F.when(log.contains(_FINISHED), F.lit(-1)).otherwise(F.lit(0)).cast("long")
            ),
            "error": F.when(F.col(exit_code) != 0, error),
        }
    )


# External programs ---------------------------------------------------------------------------

def _killed(pid: int) -> None:
    """End a child with every program it has started, and collect it."""
    try:
        os.killpg(pid, signal.SIGKILL)
    except ProcessLookupError:
        pass  # it ended by itself and left no program behind
    os.waitpid(pid, 0)


#: What a chunk does to start a process of its own, by the names Python's audit hooks have for it.
_STARTS = {
    "subprocess.Popen", "os.system", "os.fork", "os.forkpty", "os.posix_spawn", "os.spawn", "pty.spawn",
}


def _alone(started: list[str]) -> bool:
    """True if this process has started neither a program nor a thread that may outlive a chunk."""
    try:
        os.waitid(os.P_ALL, 0, os.WEXITED | os.WNOHANG | os.WNOWAIT)
    except ChildProcessError:
        return not started and threading.active_count() == 1
    return False


def _serve(fn: Callable, pipe) -> None:
    """Answer chunk after chunk until the other end closes, or a chunk leaves something behind."""
    started: list[str] = []
    sys.addaudithook(lambda event, _: started.append(event) if event in _STARTS else None)
    alone = True
    while alone:
        try:
            part, timeout = pipe.recv()
        except EOFError:
            return
        try:
            fine, answer = True, fn(part, timeout)
        except Exception as exc:
            fine, answer = False, f"{type(exc).__name__}: {exc}"
        alone = _alone(started)
        pipe.send((fine, answer, alone))


class Supervised:
    """`fn(part, timeout)` in a process beside this one, ended with its programs at the time limit.

    The process answers many chunks, as starting one costs more than a short chunk. One that was too
    slow, crashed or started programs or threads ends with its chunk, and the next chunk gets a new
    one. Raises TimeoutError at the limit, RuntimeError where the process ends without an answer,
    and what `fn` raises as RuntimeError with its name.
    """

    def __init__(self, fn: Callable):
        self.fn = fn
        self.pid = 0

    def _start(self) -> None:
        self.pipe, theirs = Pipe()
        self.pid = os.fork()
        if not self.pid:
            try:
                os.setpgid(0, 0)
                self.pipe.close()
                _serve(self.fn, theirs)
            finally:
                os._exit(0)  # nothing of the worker runs on in the child
        theirs.close()
        try:
            os.setpgid(self.pid, self.pid)  # whichever of the two comes first
        except (PermissionError, ProcessLookupError):
            pass

    def __call__(self, part: list, timeout: float):
        if not self.pid:
            self._start()
        alone = False
        try:
            self.pipe.send((part, timeout))
            if not self.pipe.poll(timeout):
                raise TimeoutError(f"over {timeout:g} seconds")
            fine, answer, alone = self.pipe.recv()
        except (EOFError, ConnectionError):
            raise RuntimeError("the process ended without an answer") from None
        finally:
            if not alone:
                self.close()
        if not fine:
            raise RuntimeError(answer)
        return answer

    def close(self) -> None:
        if self.pid:
            _killed(self.pid)
            self.pipe.close()
            self.pid = 0


def program(argv: Sequence[str]) -> Callable[[list[tuple[str, str]], float], dict[str, str]]:
    """A command as `fn` of `run_external`: it reads `key<TAB>sequence` lines and writes
    `key<TAB>output` lines; keys without a line have failed. An exit code other than 0 fails them
    all."""

    def run(part: list[tuple[str, str]], timeout: float) -> dict[str, str]:
        lines = "".join(f"{k}\t{s}\n" for k, s in part)
        # In the child's process group, so the supervisor's kill reaches it too.
        done = subprocess.run(list(argv), input=lines, capture_output=True, text=True)
        if done.returncode:
            raise RuntimeError(f"exit code {done.returncode}: {done.stderr.strip()[-200:]}")
        return dict(x.split("\t", 1) for x in done.stdout.splitlines() if "\t" in x)

    return run


def run_external(
    df: DataFrame,
    fn: Callable[[list[tuple[str, str]], float], dict[str, str]],
    key: str = "key",
    seq: str = "seq",
    chunk: int = 10,
    timeout: float = 120.0,
    min_len: int = 20,
    max_len: int = 3000,
) -> DataFrame:
    """Run a program on every sequence inside the tasks; each row comes back with a status.

    `fn(list of (key, seq), timeout)` returns key -> output text and may raise; it runs in a process
    beside the task's, a new one wherever a chunk was too slow, crashed or started programs. A chunk
    that fails, crashes its process or is not done after `timeout` seconds (then the process and what
    it started are killed) marks its own rows `failed` and the rest go on; lengths outside the window
    are `skipped`. Rows reach `fn` in small chunks whatever the partition size.
    """

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beside = Supervised(fn)
        try:
            yield from results(batches, beside)
        finally:
            beside.close()

    def results(batches: Iterator[pd.DataFrame], beside: Supervised) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf[seq].fillna("").str.len()
            fit = (n >= min_len) & (n <= max_len)
            rows = pdf.loc[~fit, [key]].assign(
                status="skipped", output=None, error="length out of range"
            )
            out = [rows]
            todo = list(zip(pdf.loc[fit, key], pdf.loc[fit, seq]))
            for i in range(0, len(todo), chunk):
                part = todo[i:i + chunk]
                try:
                    got, error = beside(part, timeout), "no output"
                except TimeoutError as exc:
                    got, error = {}, f"timeout: {exc}"
                except Exception as exc:  # one chunk must not end the task
                    got, error = {}, str(exc)
                out.append(
                    pd.DataFrame(
                        [
                            (k, "computed" if k in got else "failed", got.get(k),
                             None if k in got else error)
                            for k, _ in part
                        ],
                        columns=[key, "status", "output", "error"],
                    )
                )
            yield pd.concat(out, ignore_index=True)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, seq).mapInPandas(
        stage, f"{key} {kind}, status string, output string, error string"
    )
