from postpulse.plans.analyse import AnalysisReport, analyse
from postpulse.plans.collect import clean, collect
from postpulse.plans.train import TrainReport, label, tokens_of, train

__all__ = ["AnalysisReport", "TrainReport", "analyse", "clean", "collect", "label", "tokens_of", "train"]
