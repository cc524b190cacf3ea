"""Shared inputs of the corpus operators' tests."""

PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n=80):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + str(r.randrange(60)) for _ in range(n))


def corpus():
    """Every awkward case: nulls, blanks, ties, repeated rows, copies, near copies, shared passages, a long text."""
    a, b = prose(1), prose(2, 120)
    near = b.split()
    near[60] = "changed"
    rows = [
        (1, a), (2, a), (3, a.replace(" ", "\n  ", 5)), (4, b), (5, " ".join(near)), (6, None), (7, ""), (8, " \t\n "), (9, "one two"), (10, "one  two"),
        (11, "Ünï cödé " + prose(3)), (12, prose(4) + " " + " ".join(a.split()[10:60])), (None, prose(5)), (None, a), (4, b), (13, "x" * 5000), (14, prose(6, 6000)), (15, "same " * 200), (16, "ONE TWO"),
    ]
    return rows
