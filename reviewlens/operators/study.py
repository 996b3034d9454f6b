"""M1, M5 and S11 as one run: tune every model and draw every curve, resumable.

A :class:`Study` works through steps: one (model, grid point, fold) of the
search or one (model, train size, fold) of the curves. Every finished step is an
event in the run ledger that carries its result, every failed one an event with
its error. A step's state is its latest event, so committing one twice changes
nothing, and a run that is started again under the same id repeats no finished
step. Failed steps are tried again.

Models have events of their own ("tune", "curve"), written when their last step
is; F4 and M4 read these.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from functools import cache
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import tuning as TU
from reviewlens.operators.prepare import hash_rank_fraction, kfold
from reviewlens.sources.store import RunLedger, pending_models, tuning_status

RESULT = "model string, grid_index int, params string, fold int, score double, seconds double"
CURVE = "model string, train_size double, fold int, split string, score double, error string"


class Study:
    def __init__(self, df: DataFrame, ledger: RunLedger, run_id: str, label_col: str, cols: list[str] | None = None,
                 vector: str | None = None, id_col: str = "row_id", parallelism: int = 4, seed: int = 42):
        self.df, self.ledger, self.run_id, self.label_col = df, ledger, run_id, label_col
        self.cols, self.vector, self.id_col, self.parallelism, self.seed = cols, vector, id_col, parallelism, seed

    # ---------------------------------------------------------------- ledger
    def _latest(self, stage: str) -> DataFrame:
        """Latest event of every step of a stage of this run."""
        e = self.ledger.events().where((F.col("run_id") == self.run_id) & (F.col("stage") == stage))
        return e.groupBy("model").agg(F.max_by(F.struct("status", "payload"), "at").alias("e")).select(
            F.col("model").alias("step"), "e.status", "e.payload")

    def _run(self, stage: str, model: str, steps: dict[str, dict], work) -> bool:
        """Run the steps of a model that are not finished; true if all are then."""
        done = {r["step"] for r in self._latest(f"{stage}_step").where("status = 'completed'").select("step").collect()}
        left = {k: v for k, v in steps.items() if k not in done}

        def one(item):
            step, task = item
            t0 = time.time()
            try:
                found = work(**task)
            except Exception as e:      # the step's own event tells; the run goes on with the others
                self.ledger.append(self.run_id, f"{stage}_step", step, "failed", {**task, "error": f"{type(e).__name__}: {e}"[:2000]})
                return False
            self.ledger.append(self.run_id, f"{stage}_step", step, "completed", {**task, **found, "seconds": time.time() - t0})
            return True
        if left:
            self.ledger.append(self.run_id, stage, model, "started", {"steps": len(steps), "left": len(left)})
        with ThreadPoolExecutor(max_workers=max(1, self.parallelism)) as ex:
            good = all(list(ex.map(one, left.items())))
        return good

    def _close(self, stage: str, model: str, good: bool, payload: dict) -> None:
        if self.ledger.is_done(self.run_id, stage, model):
            return
        self.ledger.append(self.run_id, stage, model, "completed" if good else "failed", payload)

    # ---------------------------------------------------------------- M1
    def tune(self, grids: dict[str, dict | None], k_folds: int = 3, metric: TU.Metric = "f1", zero_division: float = 1.0) -> DataFrame:
        """The steps of all models and grid points, as of :func:`tuning.grid_search`,
        with rows of failed steps (score NULL)."""
        @cache
        def rows():         # written for the first step that is left to do
            return TU.fold_rows(self.df, k_folds, self.label_col, self.cols, self.vector, self.id_col, self.seed, metric)
        lock, scalers = Lock(), {}

        def work(model, grid_index, params, fold):
            with lock:
                data = rows()
            held = data if fold < 0 else data.where(F.col("fold") == fold)
            train = data if fold < 0 else data.where(F.col("fold") != fold)
            s = TU._fit_score(train, held, model, params, self.label_col, self.cols, self.vector, self.id_col, metric, zero_division,
                              scalers[model].get(fold, train) if fold >= 0 else None)
            return {"score": TU._number(s["metric"])}
        for model, grid in grids.items():
            points = TU.param_grid(grid or TU.DEFAULT_GRIDS[model])
            scalers[model] = TU.FoldScalers(model, points, self.cols, self.vector, self.id_col)
            folds = [-1] if model in TU.WHOLE_DATA_MODELS else range(k_folds)
            steps = {f"{model}/{json.dumps(p, sort_keys=True)}/{f}": dict(model=model, grid_index=i, params=p, fold=f)
                     for i, p in enumerate(points) for f in folds}
            good = self._run("tune", model, steps, work)
            best = TU.best_params(self.results().where((F.col("model") == model) & F.col("score").isNotNull())).first()
            self._close("tune", model, good, {"best_params": json.loads(best["params"]) if best else None,
                                              "best_score": best["mean_test_score"] if best else None})
        return self.results()

    def results(self) -> DataFrame:
        found = self._latest("tune_step").select(F.from_json("payload", RESULT).alias("p"), F.col("status"))
        return found.select("p.model", "p.grid_index", "p.params", "p.fold",
                            F.when(F.col("status") == "completed", F.col("p.score")).alias("score"), "p.seconds")

    def best(self) -> DataFrame:
        """O5 over the finished steps."""
        return TU.best_params(self.results().where(F.col("score").isNotNull()))

    # ---------------------------------------------------------------- M5
    def curves(self, params: dict[str, dict], train_sizes=(0.3, 0.5333, 0.7667, 1.0), k_folds: int = 2,
               metric: TU.Metric = "weighted_f1") -> DataFrame:
        """Learning curves of all models, as of :func:`tuning.learning_curves`."""
        data = kfold(self.df, k_folds, self.id_col, self.seed).withColumn("_u", hash_rank_fraction(self.id_col, self.seed + 7))

        def work(model, train_size, fold):
            train, test = TU.curve_split(data, train_size, fold)
            return {"points": TU.curve_points(train, test, model, params[model], self.label_col, self.cols, self.vector, self.id_col, metric)}
        for model in params:
            steps = {f"{model}/{s}/{f}": dict(model=model, train_size=float(s), fold=f) for s in train_sizes for f in range(k_folds)}
            self._close("curve", model, self._run("curve", model, steps, work), {"params": params[model]})
        return self.curve_results()

    def curve_results(self) -> DataFrame:
        point = "model string, train_size double, fold int, error string, points array<struct<split: string, score: double, error: string>>"
        found = self._latest("curve_step").select(F.from_json("payload", point).alias("p"))
        both = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(None).cast("double").alias("score"), F.col("p.error").alias("error"))
                         for s in ("train", "test")])
        return found.select("p.model", "p.train_size", "p.fold", F.explode(F.coalesce("p.points", both)).alias("x")).select(
            "model", "train_size", "fold", "x.split", "x.score", "x.error")

    # ---------------------------------------------------------------- F4, M4
    def pending(self, models: list[str], stage: str = "tune") -> list[str]:
        req = self.df.sparkSession.createDataFrame([(m,) for m in models], "model string")
        state = self.ledger.state().where((F.col("run_id") == self.run_id) & (F.col("stage") == stage))
        return [r["model"] for r in pending_models(req, state).orderBy("model").collect()]

    def status(self, models: list[str], stage: str = "tune") -> DataFrame:
        return tuning_status(self.ledger.state().where(F.col("run_id") == self.run_id), models, stage)


__all__ = ["Study"]
