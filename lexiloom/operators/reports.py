"""Small collected results as Markdown: tokenizer comparison and evaluation report."""

from __future__ import annotations

from pyspark.sql import DataFrame

NONE = "–"


def table(head: list[str], rows: list[list[str]], right: int | None = None) -> str:
    """right: from which column on numbers are set to the right."""
    at = 1 if right is None else right
    rule = "|" + "".join("---|" if i < at else "---:|" for i in range(len(head)))
    return "\n".join(["| " + " | ".join(head) + " |", rule, *("| " + " | ".join(r) + " |" for r in rows)])


def tokenizer_table(metrics: DataFrame, vocab: dict[str, int], baseline: str | None = None) -> str:
    """Fertility (with the change of tokens against the baseline) and bytes per token, one row a tokenizer, sets as
    columns; metrics: one row per tokenizer and set, few by nature."""
    got = {(r.tokenizer, r.text_set): r for r in metrics.select("tokenizer", "text_set", "tokens", "fertility", "bytes_per_token").collect()}
    names, sets = list(dict.fromkeys(sorted(t for t, _ in got))), sorted({s for _, s in got})

    def fertility(t: str, s: str) -> str:
        if (t, s) not in got:
            return NONE
        base = got.get((baseline, s)) if baseline and t != baseline else None
        change = f" ({100 * (got[t, s].tokens / max(base.tokens, 1) - 1):+.0f}%)" if base else ""
        return f"{got[t, s].fertility:.2f}{change}"

    rows = [[t, f"{vocab.get(t, 0):,}", *(fertility(t, s) for s in sets), *(f"{got[t, s].bytes_per_token:.2f}" if (t, s) in got else NONE for s in sets)] for t in names]
    return table(["tokenizer", "vocab", *(f"{s} fertility" for s in sets), *(f"{s} bytes/tok" for s in sets)], rows)


def matrix(df: DataFrame, row: str, column: str, value: str, name: str) -> str:
    """One row per model, one column per set or task, three decimals."""
    got = {(r[row], r[column]): r[value] for r in df.select(row, column, value).collect()}
    rows, columns = sorted({a for a, _ in got}), sorted({b for _, b in got})
    cell = lambda x: NONE if x is None else f"{x:.3f}"
    return table([name, *columns], [[r, *(cell(got.get((r, c))) for c in columns)] for r in rows])


def evaluation_report(lm: DataFrame | None, benchmarks: DataFrame | None, samples: DataFrame | None = None) -> str:
    """lm: (model, text_set, bits_per_byte); benchmarks: (model, task, acc_norm); samples: (model, prompt, completion)."""
    parts = []
    if lm is not None:
        parts += ["## Language modelling (bits per byte, lower is better)", matrix(lm, "model", "text_set", "bits_per_byte", "model")]
    if benchmarks is not None:
        parts += ["## Benchmarks (accuracy by log-likelihood per byte)", matrix(benchmarks, "model", "task", "acc_norm", "model")]
    by: dict[str, list[str]] = {}
    for r in samples.select("model", "prompt", "completion").collect() if samples is not None else ():
        by.setdefault(r.model, []).append(f"- **{r.prompt}** → {(r.completion or '').strip()}")
    for model in sorted(by):
        parts += [f"### Samples: {model}", "\n".join(by[model])]
    return "\n\n".join(parts) + "\n"
