"""What tests share."""

from pathlib import Path

DATA = Path("/root/testdata")


def same_rows(df, columns, rows):
    """Whether a DataFrame has the rows of a SQL result, in any order; doubles to nine digits."""
    assert sorted(df.columns) == sorted(columns)

    def form(r):
        return tuple((v is None, str(round(v, 9) if isinstance(v, float) else v)) for v in r)

    ours = sorted(form([r[c] for c in columns]) for r in df.collect())
    return ours == sorted(form(r) for r in rows)
