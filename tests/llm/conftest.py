import pytest


@pytest.fixture(scope="session")
def tokenizers_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path
