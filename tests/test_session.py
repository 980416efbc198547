from careloom.session import ADVISORY, tune


def test_tasks_after_a_shuffle_are_small_unless_the_user_says_otherwise(spark):
    own = spark.newSession()
    assert tune(own).conf.get(ADVISORY) == "16m"
    set_before = spark.newSession()
    set_before.conf.set(ADVISORY, "48k")
    assert tune(set_before).conf.get(ADVISORY) == "48k"
