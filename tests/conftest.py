import pytest


@pytest.fixture(scope="session")
def spark():
    from comanda.session import local_session

    return local_session("4", 4)
