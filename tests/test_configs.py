"""Rules of configurations, one broken at a time."""

import json

import pytest

from millrace.sources import configs

ARCHITECTURE = {
    "model_family": "m", "architecture_version": "v", "expert_ids": ["a", "b"], "embedding_dim": 8, "hidden_dim": 12, "num_heads": 3, "encoder_layers": 2, "chunk_size": 4, "dropout": 0.1,
    "length_scale": 8192, "generation_scale": 2048.0,
}
TRAINING = {
    "architecture_config": "a", "train_data": "t", "valid_data": "v", "base_model_path": "b", "embedding_weight_key": "k", "output_dir": "o", "seed": 42, "epochs": 1, "batch_size": 4, "lr": 1e-4,
    "betas": [0.9, 0.95], "eps": 1e-8, "weight_decay": 0, "warmup_ratio": 0.05, "min_lr_ratio": 1, "max_grad_norm": 1.0, "temperature": 0.1, "precision": "bf16", "num_workers": 0, "pin_memory": True,
    "max_prompt_tokens": 8192,
}
CASES = [
    (ARCHITECTURE, configs.ARCHITECTURE, {}, set()), (TRAINING, configs.TRAINING, {}, set()), (ARCHITECTURE, configs.ARCHITECTURE, {"model_family": ""}, {"names"}),
    (ARCHITECTURE, configs.ARCHITECTURE, {"expert_ids": ["a", "a"]}, {"expert_ids"}), (ARCHITECTURE, configs.ARCHITECTURE, {"expert_ids": []}, {"expert_ids"}),
    (ARCHITECTURE, configs.ARCHITECTURE, {"expert_ids": ["a", ""]}, {"expert_ids"}), (ARCHITECTURE, configs.ARCHITECTURE, {"embedding_dim": 0}, {"dimensions"}),
    (ARCHITECTURE, configs.ARCHITECTURE, {"num_heads": 5}, {"num_heads"}), (ARCHITECTURE, configs.ARCHITECTURE, {"encoder_layers": 3, "chunk_size": 0}, {"encoder_layers", "chunk_size"}),
    (ARCHITECTURE, configs.ARCHITECTURE, {"dropout": 1}, {"dropout"}), (ARCHITECTURE, configs.ARCHITECTURE, {"length_scale": None}, {"scales"}),
    (TRAINING, configs.TRAINING, {"train_data": ""}, {"paths"}), (TRAINING, configs.TRAINING, {"train_data": 5}, {"paths"}), (TRAINING, configs.TRAINING, {"seed": 1.5}, {"seed"}),
    (TRAINING, configs.TRAINING, {"seed": True}, {"seed"}), (TRAINING, configs.TRAINING, {"epochs": 0, "num_workers": -1}, {"epochs", "num_workers"}),
    (TRAINING, configs.TRAINING, {"pin_memory": 1}, {"pin_memory"}), (TRAINING, configs.TRAINING, {"precision": "fp16"}, {"precision"}), (TRAINING, configs.TRAINING, {"betas": [0.9]}, {"betas"}),
    (TRAINING, configs.TRAINING, {"betas": [0.9, 1]}, {"betas"}), (TRAINING, configs.TRAINING, {"lr": 0, "eps": -1}, {"lr", "eps"}), (TRAINING, configs.TRAINING, {"temperature": "1"}, {"temperature"}),
    (TRAINING, configs.TRAINING, {"weight_decay": -0.1}, {"weight_decay"}), (TRAINING, configs.TRAINING, {"warmup_ratio": 1, "min_lr_ratio": 1.1}, {"warmup_ratio", "min_lr_ratio"}),
]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """All cases of a kind at once, as files."""
    out = {}
    for name, rules in (("architecture", configs.ARCHITECTURE), ("training", configs.TRAINING)):
        at = tmp_path_factory.mktemp(name)
        for k, (good, own, change, _) in enumerate(CASES):
            if own is rules:
                (at / f"{k}.json").write_text(json.dumps({c: v for c, v in (good | change).items() if v is not None}, indent=1))
        (at / "broken.json").write_text("{")
        for r in configs.violations(configs.files(spark, str(at)), rules).collect():
            out.setdefault(r["path"].rsplit("/", 1)[1].removesuffix(".json"), set()).add(r["problem"])
    return out


@pytest.mark.parametrize("k", range(len(CASES)))
def test_rules(found, k):
    assert found.get(str(k), set()) == CASES[k][3]


def test_what_cannot_be_read(found):
    assert found["broken"] == {"json"}
