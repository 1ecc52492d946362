"""What happens between the rounds of training: metrics are kept, the best model too, and training may stop."""

from __future__ import annotations


class History:
    """Metrics by round, as rows of (group, metric, step, value), and one-time metrics without a step."""

    def __init__(self):
        self.rows: list[tuple[str, str, int | None, float]] = []

    def log(self, metric: str, value: float, step: int | None = None, group: str = "train") -> None:
        if step is None and any(r[:3] == (group, metric, None) for r in self.rows):
            raise ValueError(f"{metric} was logged before")
        self.rows.append((group, metric, step, float(value)))

    def values(self, metric: str, group: str = "train") -> list[float]:
        return [v for g, m, _, v in self.rows if (g, m) == (group, metric)]

    def table(self, spark):
        return spark.createDataFrame(self.rows, "group string, metric string, step int, value double")


class Callback:
    """Hooks of a training; ``need_stop`` is asked after each round."""

    def on_train_begin(self, model) -> None: ...

    def on_round_begin(self, model, step: int) -> None: ...

    def on_round_end(self, model, step: int, metrics: dict[str, float]) -> None: ...

    def on_train_end(self, model) -> None: ...

    def need_stop(self) -> bool:
        return False


class EarlyStop(Callback):
    """Stops when the metric has not got better for ``rounds`` rounds; keeps the best model."""

    def __init__(self, metric: str, rounds: int, higher_is_better: bool = False, history: History | None = None):
        if rounds < 1:
            raise ValueError("at least one round")
        self.metric, self.rounds, self.sign, self.history = metric, rounds, 1 if higher_is_better else -1, history or History()
        self.best_value, self.best_step, self.best_model, self.since = None, None, None, 0

    def on_round_end(self, model, step, metrics):
        for name, value in metrics.items():
            self.history.log(name, value, step)
        value = metrics[self.metric]
        if self.best_value is None or self.sign * value > self.sign * self.best_value:
            self.best_value, self.best_step, self.best_model, self.since = value, step, model, 0
        else:
            self.since += 1

    def need_stop(self):
        return self.since >= self.rounds


class Checkpoint(Callback):
    """Calls ``save(model, step)`` every so many rounds and at the end."""

    def __init__(self, save, every: int = 1):
        if every < 1:
            raise ValueError("every is a positive number of rounds")
        self.save, self.every = save, every

    def on_round_end(self, model, step, metrics):
        if (step + 1) % self.every == 0:
            self.save(model, step)
