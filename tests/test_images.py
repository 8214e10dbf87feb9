import numpy as np

from lodestone.operators import images


def page(h=200, w=200):
    image = np.full((h, w), 230, np.uint8)
    for y in range(10, h - 20, 12):
        image[y : y + 5, 10 : w - 10 : 3] = 20
    return image


def test_features_and_bands(spark):
    text, flat = page(), np.full((200, 200), 128, np.uint8)
    rows = [(1, 200, 200, text.tobytes()), (2, 200, 200, flat.tobytes()), (3, 0, 0, b""), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, width int, height int, pixels binary")
    got = {r["id"]: r for r in images.measured(df.where("id < 4")).collect()}
    assert got[1]["blur"] > got[2]["blur"] == 0 and got[1]["edges"] > 0.1 > got[2]["edges"] and got[3]["quality"] == 0
    image = text.astype(np.float32)
    assert images.missing_band(image, [(0, 100)]) and not images.missing_band(image, [(0, 200)])


def test_incomplete(spark):
    item = [("x", 0.9, 0.0, 0.0, 200.0, 200.0)]
    df = spark.createDataFrame([(1, 200, 200, page().tobytes(), item, "word " * 30), (2, 200, 200, page().tobytes(), item, "two words"), (3, 200, 200, page().tobytes(), [], "")], "id int, width int, height int, pixels binary, items array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>, text string")
    assert {r["id"]: r["incomplete"] for r in images.incomplete(df).collect()} == {1: False, 2: True, 3: True}


def test_prepared():
    image = np.pad(page().astype(np.float32), 50, constant_values=230)
    out = images.prepared(image.copy(), 100)
    assert out.shape[1] <= 100 and 0 <= out.min() and out.max() <= 255
    assert 0 <= images.signature_score(image) <= 1 and images.signature_score(np.zeros((0, 0))) == 0
