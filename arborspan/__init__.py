"""Shape-function trees and training-data operators on Spark DataFrames."""
