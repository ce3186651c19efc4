"""What several test modules share."""

SMALL = "/root/testdata/sf0.001"


def norm(rows, columns):
    def one(x):
        return "\\N" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(one(r[c]) for c in sorted(columns)) for r in rows)
