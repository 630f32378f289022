"""Models: forests, boosted trees and networks, their training, use, and files."""

from .fit import ml_fit, ml_predict
from .metadata import MLModel, ModelInput, ModelOutput
from .models import Model, mlm_class_lighttae, mlm_class_random_forest, mlm_class_tempcnn, mlm_class_xgboost, mlm_regr_random_forest
from .persist import load_stac_ml, save_ml_model

__all__ = [
    "MLModel", "Model", "ModelInput", "ModelOutput", "load_stac_ml", "ml_fit", "ml_predict", "mlm_class_lighttae",
    "mlm_class_random_forest", "mlm_class_tempcnn", "mlm_class_xgboost", "mlm_regr_random_forest", "save_ml_model",
]
