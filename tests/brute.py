"""Plain Python versions of the order-dependent rules, for small inputs."""


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def match(preds, gts, level=0.5, tie="last"):
    """preds: (image, class, index, score, box); gts: (image, class, index, box)."""
    found, out = set(), {}
    for im, c, i, s, b in sorted(preds, key=lambda p: (-p[3], p[2])):
        options = [
            (iou(b, gb), gi if tie == "last" else -gi, gi)
            for gim, gc, gi, gb in gts
            if gim == im and gc == c and (gim, gc, gi) not in found and iou(b, gb) >= level
        ]
        best = max(options, default=None)
        out[(im, c, i)] = best[2] if best else None
        if best:
            found.add((im, c, best[2]))
    return out


def suppress(preds, level=0.5):
    kept = []
    for p in sorted(preds, key=lambda p: (-p[3], p[2])):
        if all((k[0], k[1]) != (p[0], p[1]) or iou(k[4], p[4]) <= level for k in kept):
            kept.append(p)
    return {(p[0], p[1], p[2]) for p in kept}


def scene(rng, images=3, n_gt=6, n_pred=12, size=60):
    def rect():
        x, y = rng.randrange(size), rng.randrange(size)
        return (float(x), float(y), float(x + rng.randrange(4, 30)), float(y + rng.randrange(4, 30)))

    gts, preds = [], []
    for im in range(images):
        gts += [(im, rng.randrange(2), i, rect()) for i in range(n_gt)]
        for i in range(n_pred):
            if rng.random() < 0.7:
                _, c, _, b = gts[im * n_gt + rng.randrange(n_gt)]
                d = rng.randrange(-3, 4)
                b = (b[0] + d, b[1], b[2] + d, b[3])
            else:
                c, b = rng.randrange(2), rect()
            preds.append((im, c, i, rng.randrange(10) / 10, b))
    return preds, gts


def frames(spark, preds, gts):
    p = spark.createDataFrame(
        [(im, c, i, float(s), *b) for im, c, i, s, b in preds],
        "image_id bigint, class_id int, pred_index int, score double, x1 double, y1 double, x2 double, y2 double",
    )
    g = spark.createDataFrame(
        [(im, c, i, *b) for im, c, i, b in gts],
        "image_id bigint, class_id int, gt_index int, x1 double, y1 double, x2 double, y2 double",
    )
    return p, g
