import pytest

from seqloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", cores=8)
