"""Plain counterparts the operators are compared with."""


def smallest_reachable(points, linked):
    """Component of each point by plain search; ``linked(a, b)`` on indexes."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]
