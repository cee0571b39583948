"""Where trees and sections come from; every source returns a DataFrame."""
