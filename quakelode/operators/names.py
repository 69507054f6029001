"""Names that clash with no column."""


def fresh(columns: list[str], *names: str) -> list[str]:
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
